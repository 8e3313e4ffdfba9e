"""Queries and SQL of the retrieval family: ``benchmark`` items ask ``documents``; ``embeddings`` are the vectors of documents of the same id."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import text as fx
from corpuscle.operators import retrieval as op
from corpuscle.operators import text as tx
from corpuscle.plans.text import POSTINGS
from corpuscle.sources.tables import spread, table


def _queries(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _postings(s, d):
    return tx.postings(spread(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")), "id", mark=True)


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _asked(s, d):
    """Every hundredth vector asks."""
    return _vectors(s, d).where("id % 100 = 0").withColumnRenamed("id", "query_id")


def _bm25(s, d, k=op.POOL):
    return op.bm25_topk(_queries(s, d), _postings(s, d), k)


def _semantic(s, d, k=op.POOL):
    """Benchmark item i asks with vector i."""
    q = _queries(s, d).join(_vectors(s, d), F.col("query_id") == F.col("id")).select("query_id", "embedding")
    return op.vector_topk(q, _vectors(s, d).drop("label"), k)


def _visible(s, d):
    """Chunks are documents: every tenth source is archived, every 17th document is flagged."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("repository_id"))
    chunks = docs.withColumn("id", F.col("document_id"))
    state = docs.withColumn("archived_at", F.when(F.col("repository_id") == "src3", F.lit("2024-01-01")))
    flags = docs.select("document_id", (F.col("document_id") % 17 == 0).alias("needs_rebuild")).where("document_id % 2 = 0")
    return op.visible_chunks(chunks, state, flags)


def _hybrid(s, d):
    return op.hybrid_search(_semantic(s, d), _bm25(s, d), _visible(s, d))


def _overview_hits(s, d, k=3):
    """The overview chunks are those of every tenth document, searched by themselves."""
    q = _queries(s, d).join(_vectors(s, d), F.col("query_id") == F.col("id")).select("query_id", "embedding")
    return op.vector_topk(q, _vectors(s, d).where("id % 10 = 0").drop("label"), k)


def _web(s, d):
    """Documents as chunks of pages: a URL for each four documents."""
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("https://h.test/"), F.floor(F.col("doc_id") / 4).cast("long")).alias("url"), F.col("source").alias("title"), "text")


def _lists(s, d):
    """Two result lists of each item, by keyword and by vector, as search results with content."""
    c = _web(s, d)
    out = None
    for i, r in enumerate((_bm25(s, d, 10), _semantic(s, d, 10))):
        part = r.join(c, "id").select(F.col("query_id").alias("request_id"), F.lit(i).alias("query_no"), "rank", F.when(F.col("rank") % 2 == 0, F.concat("url", F.lit("/?utm_x=1"))).otherwise(F.col("url")).alias("url"), F.col("id").cast("string").alias("title"), F.col("text").alias("content"))
        out = part if out is None else out.unionByName(part)
    return out


def _memory(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("repository_id"), F.when(F.col("vec_id") % 3 == 0, "note").otherwise("summary").alias("kind"))
    rows = v.select("id", "kind", F.floor(F.col("id") / 6).cast("long").alias("source_id"), F.when(F.col("id") % 5 == 0, "stale").when(F.col("id") % 2 == 0, "ready").otherwise("saved").alias("state"), (F.col("id") % 7 != 0).alias("indexed"))
    return op.memory_search(v.where("id % 100 = 0").withColumnRenamed("id", "query_id"), v, rows, 5, 0.1)


def _first(s, d):
    r = _lists(s, d).select("request_id", F.when(F.col("query_no") == 0, "local").otherwise("web").alias("channel"), "rank", "url", (F.col("request_id") % 2 == 0).alias("explicit")).where("not (channel = 'local' and request_id % 3 = 0)")
    channels = s.createDataFrame([("local", 0, True), ("web", 1, False)], "channel string, ordinal int, local boolean")
    return op.first_available(r, channels)


def _labels(s, d):
    docs = _bm25(s, d, 8).select("query_id", F.lit("S").alias("channel"), F.lit("doc").alias("kind"), F.col("id").alias("source_id"), "rank")
    mem = _semantic(s, d, 8).select("query_id", F.lit("M").alias("channel"), F.lit("memory").alias("kind"), F.floor(F.col("id") / 10).cast("long").alias("source_id"), "rank")
    web = _semantic(s, d, 12).select("query_id", F.lit("W").alias("channel"), F.lit("web").alias("kind"), F.col("id").alias("source_id"), "rank")
    return op.label_sources(docs.unionByName(mem).unionByName(web), offset=2)


def _hit_rate(s, d):
    """A document that holds an item's text is gold. Only ranked documents are looked at: a gold one that isn't ranked is a miss either way."""
    ranks = _bm25(s, d, 3).select("query_id", "id", "rank", F.lit("bm25").alias("channel")).unionByName(_semantic(s, d, 3).select("query_id", "id", "rank", F.lit("vector").alias("channel")))
    texts = ranks.select("query_id", "id").distinct().join(_queries(s, d).withColumnRenamed("text", "q"), "query_id").join(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    held = texts.where(F.contains("text", F.col("q"))).select("query_id", "id")
    kind = fx.language(F.col("q"))
    gold = _queries(s, d).withColumnRenamed("text", "q").join(held, "query_id", "left").select("query_id", kind.alias("kind"), "id")
    return op.hit_rate(ranks, gold)


def _filtered_page(s, d):
    """Line items as the items of a batch: state, selected, and a scope of suppliers and parts."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("state"), (F.col("l_quantity") % 2 == 0).alias("selected"), F.array(F.col("l_suppkey") % 10, F.col("l_partkey") % 10).cast("array<long>").alias("repository_ids"))
    return op.keyset_page(li, ["l_orderkey", "l_linenumber"], [5, 0], 50, {"state": "N", "selected": True}, ("repository_ids", [3, 7])).drop("repository_ids")


def _separability(s, d):
    scores = op.vector_topk(_asked(s, d).drop("label"), _vectors(s, d).drop("label"), 50).join(table(s, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("class")), "id")
    return op.score_separability(scores.select("query_id", "class", "score"))


def _freshness(s, d):
    e = _vectors(s, d)
    new = e.select("id", F.transform("embedding", lambda x, i: x + F.when(i == F.col("id") % 64, 0.01).otherwise(0.0)).alias("embedding"))
    return op.index_freshness(e, new)


QUERIES = {
    "p1_visible_chunks": lambda s, d: _visible(s, d).select("id"),
    "a1_bm25_stats": lambda s, d: op.bm25_stats(_postings(s, d)).select("term", "df", "n_docs", F.round("avgdl", 6).alias("avgdl")),
    "k1_vector_topk": lambda s, d: op.vector_topk(_asked(s, d), _vectors(s, d), 10, ["label"]),
    "k2_bm25_topk": lambda s, d: _bm25(s, d, 10),
    "k3_bm25plus": lambda s, d: op.bm25plus_rank(_queries(s, d), _postings(s, d), 10),
    "k4_hybrid": lambda s, d: _hybrid(s, d),
    "k5_overviews": lambda s, d: op.with_overviews(_hybrid(s, d), _overview_hits(s, d)),
    "k6_memory": _memory,
    "k7_page_results": lambda s, d: op.page_results(_bm25(s, d), _web(s, d), 5).drop("content"),
    "k8_keyset_page": lambda s, d: op.keyset_page(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").where("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"], [20, 1], 100),
    "k8_filtered_page": _filtered_page,
    "u1_rrf": lambda s, d: op.rrf(_semantic(s, d), _bm25(s, d)),
    "u2_fuse_or_rescue": lambda s, d: op.fuse_or_rescue(_bm25(s, d).where("query_id % 3 <> 0"), _semantic(s, d).where("query_id % 4 <> 0")),
    "u3_merge_results": lambda s, d: op.merge_results(_lists(s, d), 5),
    "u5_first_available": _first,
    "w7_source_labels": _labels,
    "a9_hit_rate": _hit_rate,
    "a10_separability": _separability,
    "a11_freshness": _freshness,
}

_TERM = r"'[\x{4e00}-\x{9fff}]|[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+'"
_BM = f"""{POSTINGS}, corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS i FROM df, corpus), idf AS (SELECT term, CASE WHEN i < 0 THEN 0.25 * (SELECT avg(i) FROM raw) ELSE i END AS idf FROM raw),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(coalesce(text, ''), {_TERM})) AS term FROM benchmark) GROUP BY 1, 2),
bs AS (SELECT query_id, doc_id AS id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN idf USING (term) JOIN post USING (term), corpus GROUP BY 1, 2),
bm AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bs WHERE score > 0)"""
_COS = "round(greatest(-1, least(1, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"
_VE = f"""vs AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
ve AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs)"""
_VIS = "vis AS (SELECT doc_id AS id FROM documents WHERE source <> 'src3' AND NOT (doc_id % 17 = 0 AND doc_id % 2 = 0))"


def _rrf_sql(a, b, name):
    return f"""{name}_u AS (SELECT query_id, id, rank, 0 AS l FROM {a} UNION ALL SELECT query_id, id, rank, 1 FROM {b}),
{name}_g AS (SELECT query_id, id, round(sum(1 / (60.0 + rank)), 9) AS score, min((l, rank)) AS seen FROM {name}_u GROUP BY 1, 2),
{name} AS (SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen))::INTEGER AS rank, score FROM {name}_g)"""


_HY = f"""WITH {_BM}, {_VE}, {_VIS}, v0 AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ve JOIN vis USING (id) WHERE rank <= 50),
w0 AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm JOIN vis USING (id) WHERE rank <= 50), {_rrf_sql("v0", "w0", "f")},
h AS (SELECT f.query_id, f.id, f.score AS fused_score, v0.score AS vector_score, w0.score AS keyword_score, row_number() OVER (PARTITION BY f.query_id ORDER BY f.rank) AS rank FROM f LEFT JOIN v0 ON v0.query_id = f.query_id AND v0.id = f.id LEFT JOIN w0 ON w0.query_id = f.query_id AND w0.id = f.id WHERE v0.score > 0 OR w0.score > 0),
hy AS (SELECT h.query_id, h.rank::INTEGER AS rank, h.id, vector_score, keyword_score, fused_score, coalesce((SELECT max(score) FROM v0 WHERE v0.query_id = h.query_id), 0.0) AS max_score FROM h WHERE h.rank <= 5)"""
_WEB = "web AS (SELECT doc_id AS id, 'https://h.test/' || (doc_id // 4) AS url, source AS title, text FROM documents)"
_LI = f"""{_BM}, {_VE}, {_WEB}, li AS (SELECT query_id AS request_id, query_no, rank, CASE WHEN rank % 2 = 0 THEN url || '/?utm_x=1' ELSE url END AS url, url AS key, id::VARCHAR AS title, text AS content
FROM (SELECT *, 0 AS query_no FROM bm WHERE rank <= 10 UNION ALL SELECT query_id, id, score, rank, 1 FROM ve WHERE rank <= 10) JOIN web USING (id))"""

ORACLES = {
    "p1_visible_chunks": f"WITH {_VIS} SELECT id FROM vis",
    "a1_bm25_stats": f"WITH {POSTINGS} SELECT term, count(*) AS df, (SELECT count(*) FROM tok) AS n_docs, (SELECT round(avg(len(t)), 6) FROM tok) AS avgdl FROM post GROUP BY 1",
    "k1_vector_topk": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 10""",
    "k2_bm25_topk": f"WITH {_BM} SELECT query_id, id, score, rank::INTEGER AS rank FROM bm WHERE rank <= 10",
    "k3_bm25plus": f"""WITH {POSTINGS}, q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(coalesce(text, ''), {_TERM})) AS term FROM benchmark) GROUP BY 1, 2),
h AS (SELECT query_id, doc_id AS id, term, tf, dl, qtf FROM q JOIN post USING (term)), c AS (SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT query_id, id, dl FROM h) GROUP BY 1),
i AS (SELECT query_id, term, ln((any_value(n) + 1) / count(*)) AS idf, any_value(qtf) AS qtf FROM h JOIN c USING (query_id) GROUP BY 1, 2), b AS (SELECT query_id, sum(qtf * idf) AS base FROM i GROUP BY 1),
s AS (SELECT query_id, id, round(sum(h.qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) + any_value(base), 6) AS score FROM h JOIN i USING (query_id, term) JOIN c USING (query_id) JOIN b USING (query_id) GROUP BY 1, 2),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank FROM s) SELECT * FROM r WHERE rank <= 10""",
    "k4_hybrid": f"{_HY} SELECT * FROM hy",
    "k5_overviews": f"""{_HY}, o AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs WHERE id % 10 = 0),
u AS (SELECT query_id, 0 AS part, rank, id, score AS vector_score, NULL::DOUBLE AS keyword_score, 0.0::DOUBLE AS fused_score FROM o WHERE rank <= 3 UNION ALL SELECT query_id, 1, rank, id, vector_score, keyword_score, fused_score FROM hy)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY part, rank))::INTEGER AS position, part, id, vector_score, keyword_score, fused_score FROM u""",
    "k6_memory": f"""WITH v AS (SELECT vec_id AS id, embedding, label, CASE WHEN vec_id % 3 = 0 THEN 'note' ELSE 'summary' END AS kind FROM embeddings),
s AS (SELECT a.id AS query_id, b.id, b.kind, {_COS} AS score FROM v a JOIN v b ON a.label = b.label AND a.kind = b.kind WHERE a.id % 100 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s),
l AS (SELECT query_id, kind, id // 6 AS source_id, score, id FROM n WHERE r <= 15 AND score >= 0.1 AND id % 5 <> 0 AND id % 7 <> 0), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind, source_id ORDER BY score DESC, id) AS m FROM l),
t AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank, kind, source_id, score FROM b WHERE m = 1) SELECT * FROM t WHERE rank <= 5""",
    "k7_page_results": f"""WITH {_BM}, {_WEB}, g AS (SELECT query_id, url, title, text, rank, row_number() OVER (PARTITION BY query_id, url ORDER BY rank) AS m FROM bm JOIN web USING (id) WHERE rank <= 15),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INTEGER AS rank, url, substr(title, 1, 512) AS title, substr(text, 1, 10000) AS snippet FROM g WHERE m = 1) SELECT * FROM r WHERE rank <= 5""",
    "k8_keyset_page": """WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS r, count(*) OVER () AS n FROM lineitem WHERE l_returnflag = 'R' AND (l_orderkey, l_linenumber) > (20, 1))
SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN r = 100 AND n > 100 THEN l_orderkey || ',' || l_linenumber END AS next_cursor FROM p WHERE r <= 100""",
    "u1_rrf": f"WITH {_BM}, {_VE}, a0 AS (SELECT * FROM ve WHERE rank <= 50), b0 AS (SELECT * FROM bm WHERE rank <= 50), {_rrf_sql('a0', 'b0', 'f')} SELECT * FROM f",
    "u2_fuse_or_rescue": f"""WITH {_BM}, {_VE}, l0 AS (SELECT * FROM bm WHERE rank <= 50 AND query_id % 3 <> 0), s0 AS (SELECT * FROM ve WHERE rank <= 50 AND query_id % 4 <> 0),
l1 AS (SELECT * FROM l0 WHERE query_id IN (SELECT query_id FROM s0)), s1 AS (SELECT * FROM s0 WHERE query_id IN (SELECT query_id FROM l0)), {_rrf_sql("s1", "l1", "f")}
SELECT query_id, id, rank FROM f UNION ALL SELECT query_id, id, rank::INTEGER FROM l0 WHERE query_id NOT IN (SELECT query_id FROM s0) UNION ALL SELECT query_id, id, rank::INTEGER FROM s0 WHERE query_id NOT IN (SELECT query_id FROM l0)""",
    "u3_merge_results": f"""WITH {_LI}, g AS (SELECT request_id, key, round(sum(1 / (60.0 + rank)), 9) AS score, min((query_no, rank)) AS seen, first((url, title) ORDER BY length(content) DESC, query_no, rank) AS item FROM li GROUP BY 1, 2),
r AS (SELECT request_id, (row_number() OVER (PARTITION BY request_id ORDER BY score DESC, seen))::INTEGER AS rank, item[1] AS url, item[2] AS title, score FROM g) SELECT * FROM r WHERE rank <= 5""",
    "u5_first_available": f"""WITH {_LI}, r AS (SELECT request_id, CASE WHEN query_no = 0 THEN 'local' ELSE 'web' END AS channel, rank, url FROM li WHERE NOT (query_no = 0 AND request_id % 3 = 0)),
p AS (SELECT *, CASE WHEN channel = 'local' THEN CASE WHEN request_id % 2 = 0 THEN 10 ELSE 0 END ELSE 1 END AS p FROM r) SELECT request_id, channel, rank::INTEGER AS rank, url FROM p WHERE p = (SELECT min(p) FROM p o WHERE o.request_id = p.request_id)""",
    "w7_source_labels": f"""WITH {_BM}, {_VE}, h AS (SELECT query_id, 'S' AS channel, 'doc' AS kind, id AS source_id, rank FROM bm WHERE rank <= 8 UNION ALL SELECT query_id, 'M', 'memory', id // 10, rank FROM ve WHERE rank <= 8 UNION ALL SELECT query_id, 'W', 'web', id, rank FROM ve WHERE rank <= 12),
f AS (SELECT query_id, channel, kind, source_id, min(rank) AS rank FROM h GROUP BY 1, 2, 3, 4), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY rank, kind, source_id) AS n FROM f)
SELECT query_id, channel || (n + CASE WHEN channel = 'W' THEN 2 ELSE 0 END) AS label, kind, source_id FROM n WHERE n <= CASE channel WHEN 'S' THEN 5 WHEN 'W' THEN 10 ELSE 1000000 END""",
    "a9_hit_rate": f"""WITH {_BM}, {_VE}, r AS (SELECT query_id, id, 'bm25' AS channel FROM bm WHERE rank <= 3 UNION ALL SELECT query_id, id, 'vector' FROM ve WHERE rank <= 3),
h AS (SELECT DISTINCT channel, query_id FROM r JOIN documents d ON d.doc_id = r.id JOIN benchmark b ON b.item_id = r.query_id WHERE contains(d.text, b.text)),
k AS (SELECT item_id AS query_id, CASE WHEN len(regexp_extract_all(text, '[A-Za-z]')) / length(text) >= 0.5 THEN 'en' ELSE 'other' END AS kind FROM benchmark), c AS (SELECT DISTINCT channel FROM r)
SELECT c.channel, k.kind, count(*) AS queries, round(avg(CASE WHEN h.query_id IS NULL THEN 0 ELSE 1 END), 6) AS hit_rate FROM k CROSS JOIN c LEFT JOIN h ON h.channel = c.channel AND h.query_id = k.query_id GROUP BY 1, 2""",
    "a10_separability": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s),
g AS (SELECT query_id, quality AS class, list_sort(list(score), 'DESC') AS s, avg(score) AS m, stddev_pop(score) AS sd FROM t JOIN labels l ON l.doc_id = t.id WHERE r <= 50 GROUP BY 1, 2),
v AS (SELECT class, unnest(['top1', 'margin', 'above_median', 'z']) AS statistic, unnest([s[1], s[1] - coalesce(s[2], 0), s[1] - s[len(s) // 2 + 1], (s[1] - m) / CASE WHEN sd = 0 THEN 1e-9 ELSE sd END]) AS v FROM g),
a AS (SELECT class, statistic, min(round(v, 6)) AS least, list_sort(list(round(v, 6)))[count(*) // 2 + 1] AS median, max(round(v, 6)) AS most FROM v GROUP BY 1, 2)
SELECT *, NOT EXISTS (SELECT 1 FROM a b WHERE b.statistic = a.statistic AND b.class <> a.class AND a.least <= b.most AND b.least <= a.most) AS separates FROM a""",
    "a11_freshness": """WITH p AS (SELECT embedding::DOUBLE[] AS a, list_transform(embedding, lambda x, i: x::DOUBLE + CASE WHEN i - 1 = vec_id % 64 THEN 0.01 ELSE 0.0 END) AS b FROM embeddings), c AS (SELECT list_cosine_similarity(a, b) AS c FROM p)
SELECT count(*) AS n, round(avg(c), 6) AS mean, round(min(c), 6) AS least, min(c) >= 0.999 AS same_source FROM c""",
}
ORACLES["k8_filtered_page"] = """WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag AS state, true AS selected, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS r, count(*) OVER () AS n FROM lineitem
WHERE l_returnflag = 'N' AND l_quantity % 2 = 0 AND (l_suppkey % 10 IN (3, 7) OR l_partkey % 10 IN (3, 7)) AND (l_orderkey, l_linenumber) > (5, 0))
SELECT l_orderkey, l_linenumber, state, selected, CASE WHEN r = 50 AND n > 50 THEN concat_ws(',', l_orderkey, l_linenumber) END AS next_cursor FROM r WHERE r <= 50"""
