"""Imports every module that registers queries."""

from __future__ import annotations

from tessera.operators import analytics, copies, joins, predicates, upserts, windows  # noqa: F401
from tessera.plans import anchor, asks, bounds, checks, conflicts, document_scan, draft_gate, drafts, evidence, exports, ledger, nearest, node_trees, provenance, retrieval, revisions, scores, text_queries, trees  # noqa: F401
from tessera.registry import QUERIES, SQL
from tessera.sources import named_files, readers  # noqa: F401
from tessera.streaming import debounce, jobs, states  # noqa: F401

__all__ = ["QUERIES", "SQL"]
