"""Query catalogue: importing the query modules registers every named query."""

from __future__ import annotations

from . import q_cluster, q_feeds, q_ingest, q_map, q_quality, q_store, q_text  # noqa: F401
from . import q_requests, q_stream  # noqa: F401  (after the others: they reuse their oracles)
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
