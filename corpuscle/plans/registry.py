"""All queries of the library and their SQL for DuckDB, by name."""

from __future__ import annotations

from corpuscle.plans import formats, maintenance, retrieval, text, web

FAMILIES = [text, web, retrieval, maintenance, formats]
QUERIES = {k: v for f in FAMILIES for k, v in f.QUERIES.items()}
ORACLES = {k: v for f in FAMILIES for k, v in f.ORACLES.items()}


def flagship(spark, folder):
    return QUERIES["k2_bm25_topk"](spark, folder)
