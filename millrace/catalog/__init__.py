"""Ready queries over the test tables, each with an equivalent SQL text where one exists."""

from millrace.catalog import corpus, learning, rebuilt, series, tables, groups  # noqa: F401  (they fill the registry)
from millrace.catalog.registry import QUERIES

__all__ = ["QUERIES"]
