"""Column-level functions: calendar parts, text and date patterns, tail probabilities."""
