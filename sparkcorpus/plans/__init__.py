"""Views of the test tables and the queries over them."""

from . import further_queries, more_queries, queries  # noqa: F401  (these register their own)
