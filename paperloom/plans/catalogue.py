"""All queries of the core with the SQL they are checked against."""

from __future__ import annotations

from paperloom.plans import document_queries, entity_queries, instruction_queries, record_queries, score_queries, search_queries  # noqa: F401
from paperloom.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "fused_search"
