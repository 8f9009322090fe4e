"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import embedding_dedup, html_extract, licenses, line_dedup, mix, pack, quality, shard, simhash, topk

MODULES = [embedding_dedup, html_extract, licenses, line_dedup, mix, pack, quality, shard, simhash, topk]

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
