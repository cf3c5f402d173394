"""All queries of the library on the driver's tables, and their SQL."""

from __future__ import annotations

from . import market_queries, reader_queries, source_queries, text_queries, training_queries

QUERIES: dict = {}
SQL: dict = {}
for _module in (market_queries, training_queries, text_queries, source_queries, reader_queries):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
