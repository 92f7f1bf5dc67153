"""All registered queries."""

from corpusframe.plans import answer_queries, history_queries, ingest_queries, retrieval_queries  # noqa: F401
from corpusframe.plans.registry import QUERIES, oracles

ORACLES = oracles()

__all__ = ["ORACLES", "QUERIES"]
