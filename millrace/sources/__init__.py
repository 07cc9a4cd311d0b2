"""Readers, writers and the landing-zone audit."""
