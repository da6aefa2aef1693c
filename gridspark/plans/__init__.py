"""Registered queries and their SQL."""

from . import block_queries, byte_queries, layout_queries, ledger_queries, window_queries  # isort: skip
from . import codec_queries, container_queries, refusal_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "block_queries", "byte_queries", "codec_queries", "container_queries", "layout_queries", "ledger_queries", "refusal_queries", "window_queries"]
