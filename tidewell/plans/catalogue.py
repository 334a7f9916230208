"""Every registered query with its SQL counterpart."""

from __future__ import annotations

from . import event_queries, index_queries, language_queries, more_queries, ranking_queries, search_queries, service_queries, sketch_queries, stateful_queries, store_queries, stored_index_queries  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES  # noqa: F401
