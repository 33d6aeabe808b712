"""Every operator as a query over the driver's tables, with the same result in SQL."""

from __future__ import annotations

from . import chat_queries, graph_queries, report_queries, search_queries, stream_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "chat_queries", "graph_queries", "report_queries", "search_queries", "stream_queries", "text_queries"]
