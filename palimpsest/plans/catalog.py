"""Every query of the library by name, with the SQL that checks it."""

from __future__ import annotations

from palimpsest.plans import q_aggregates, q_filters, q_graph, q_joins, q_lexical, q_metrics, q_plugins, q_sets, q_sources, q_streams, q_temporal, q_text, q_topk, q_windows  # noqa: F401  (they register)
from palimpsest.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "bm25_topk"
