"""All registered queries and their SQL."""

from __future__ import annotations

from quillmesh.plans import block_queries, retrieval_queries, violation_queries  # noqa: F401
from quillmesh.plans.register import ORACLE, QUERIES

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
FLAGSHIP = "bm25_topk"
