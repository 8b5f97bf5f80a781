"""All registered queries."""

from corpusmill.plans import layers, metrics, retrieval, state, streams, text  # noqa: F401
from corpusmill.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
