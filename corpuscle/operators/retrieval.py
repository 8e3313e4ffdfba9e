"""Retrieval for whole tables of queries: visible rows, BM25, exact vector top-k, rank fusion, page results, evaluation.

Rankings are tables (query_id, id, rank, score). Scores are rounded to DIGITS places before they are ranked and ties go to
the smaller id, so a ranking doesn't depend on the order in which partitions are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions import text as fx
from corpuscle.functions import urls as ux
from corpuscle.operators import topk
from corpuscle.operators.storage import cut_lineage
from corpuscle.operators.topk import DIGITS

RRF_K, POOL, SOURCES = 60, 50, 5
EPSILON, DELTA = 0.25, 1.0


def visible_chunks(chunks: DataFrame, docs: DataFrame, rebuild: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Chunks of documents that aren't archived nor flagged for a rebuild (no row: not flagged), in scope. Applied before any statistics."""
    if scope is not None:
        chunks, docs = chunks.where(F.col("repository_id").isin(scope)), docs.where(F.col("repository_id").isin(scope))
    flagged = rebuild.where("needs_rebuild").select("document_id")
    live = docs.where("archived_at is null").select("document_id").join(flagged, "document_id", "left_anti")
    return chunks.join(live, "document_id", "left_semi")


def top(scored: DataFrame, k: int, by: list[Column] | None = None) -> DataFrame:
    """The k best rows of each query, ranked. The limit reaches below the shuffle as a per-partition group limit."""
    order = Window.partitionBy("query_id").orderBy(*(by or [F.desc("score"), F.col("id")]))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_stats(post: DataFrame) -> DataFrame:
    """term, df, n_docs, avgdl over the rows of postings (id, term, tf, dl). Terms are counted with map-side combine.

    Postings that mark one row of each document (``first``) are read once: documents and lengths are summed from the terms' rows, which are
    written. Else documents are counted by id.
    """
    if "first" in post.columns:
        terms = cut_lineage(post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.count_if("first").alias("docs")))
        lengths = terms.agg(F.sum("docs").alias("n_docs"), (F.sum("tf") / F.sum("docs")).alias("avgdl"))
        return terms.select("term", "df").join(F.broadcast(lengths))
    lengths = post.groupBy("id").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    return post.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(lengths))


def okapi_idf(stats: DataFrame) -> DataFrame:
    """stats with idf: negative values become EPSILON times the mean over the whole vocabulary."""
    raw = stats.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).withColumn("idf", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))).drop("raw", "mean")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf: a repeated term counts again."""
    t = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(fx.SEARCH_TOKEN), F.lit(0))
    return queries.select("query_id", F.explode(t).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _query_hits(terms: DataFrame, post: DataFrame) -> DataFrame:
    """The postings of query terms, written once: scoring and counts read them again."""
    return cut_lineage(post.select("id", "term", "tf", "dl").join(terms.select("term").distinct(), "term", "left_semi"))


def bm25_topk(queries: DataFrame, post: DataFrame, k: int = POOL) -> DataFrame:
    """Okapi scores over 0, best k of each query. Statistics come from all postings; those of query terms alone are written and scored,
    by blocks of documents in which runs are skipped whose upper bound can't reach a query's k best."""
    terms = cut_lineage(query_terms(queries))
    idf = terms.join(okapi_idf(bm25_stats(post)), "term")
    asked = cut_lineage(idf.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list(F.col("qtf") * F.col("idf")).alias("weights"), F.first("avgdl").alias("mean")).withColumn("base", F.lit(0.0)))
    return top(topk.lexical_best(_query_hits(terms, post), asked, k).where("score > 0"), k)


def bm25plus_rank(queries: DataFrame, post: DataFrame, k: int | None = None) -> DataFrame:
    """BM25Plus over each query's own corpus, the texts that share a token with it; so N, df and mean length are per query.

    The postings of query terms are written once. A first pass over them counts each query's texts, a second one scores.
    """
    terms = cut_lineage(query_terms(queries))
    hits = _query_hits(terms, post)
    known = cut_lineage(terms.join(hits.groupBy("term").agg(F.count("*").alias("df")), "term"))
    own = topk.candidates(hits, known.groupBy("query_id").agg(F.collect_list("term").alias("terms")))
    weighed = known.join(own, "query_id").withColumn("w", F.col("qtf") * F.log((F.col("n") + 1) / F.col("df")))
    asked = cut_lineage(weighed.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights"), F.first("mean").alias("mean"), (F.sum("w") * DELTA).alias("base")))
    return top(topk.lexical_best(hits, asked, k or 1 << 30), k or 1 << 30)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, where: list[str] | None = None) -> DataFrame:
    """Exact cosine top-k (clamped to [-1, 1]); ``where`` columns must be equal on both sides and are applied before the top-k.

    queries: query_id, embedding, where...; vectors: id, embedding, where.... Both sides are dealt into blocks and each pair of blocks
    gives k rows for each query, so no side passes the driver. Null vectors take no part; a dimension that differs is an error.
    """
    if not 0 < k <= 512:
        raise ValueError("k must be from 1 to 512")
    where = where or []
    return top(topk.nearest(vectors.select("id", "embedding", *where), queries.select("query_id", "embedding", *where), k, where), k)


def rrf(*rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, id, rank): sum of 1 / (k + rank); ties by first appearance, list after list."""
    rows = None
    for i, r in enumerate(rankings):
        part = r.select("query_id", "id", "rank", F.lit(i).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    return top(fused, 1 << 30, [F.desc("score"), F.col("seen")]).select("query_id", "id", "rank", "score")


def fuse_or_rescue(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """query_id, id, rank: of queries with both lists the fused ranking (semantic first), of the others their one list as it stands."""
    part = lambda r, i: r.select("query_id", "id", "rank", F.lit(i).alias("list"))
    rows = part(semantic, 0).unionByName(part(lexical, 1)).groupBy("query_id", "id")
    fused = rows.agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("seen"), F.max("list").alias("last"))
    own = Window.partitionBy("query_id")
    both = (F.min("seen.list").over(own) == 0) & (F.max("last").over(own) == 1)
    order = F.row_number().over(own.orderBy(F.desc("score"), F.col("seen")))
    return fused.select("query_id", "id", F.when(both, order).otherwise(F.col("seen.rank")).alias("rank"))


def hybrid_search(vector: DataFrame, keyword: DataFrame, visible: DataFrame, top_k: int = SOURCES, sources: int = SOURCES) -> DataFrame:
    """Fused hits of the two channels among visible ids: both scores, fused score and the query's best vector score.

    A hit needs some evidence: a positive vector or keyword score. visible: id.
    """
    rerank = lambda d: top(d.drop("rank").join(visible.select("id"), "id", "left_semi"), 1 << 30)
    v, w = rerank(vector), rerank(keyword)
    fused = rrf(v, w)
    best = v.groupBy("query_id").agg(F.max("score").alias("max_score"))
    hits = fused.select("query_id", "id", F.col("score").alias("fused_score"), F.col("rank").alias("fused_rank"))
    hits = hits.join(v.select("query_id", "id", F.col("score").alias("vector_score")), ["query_id", "id"], "left").join(w.select("query_id", "id", F.col("score").alias("keyword_score")), ["query_id", "id"], "left")
    hits = hits.where("vector_score > 0 or keyword_score > 0").join(best, "query_id", "left")
    return top(hits, min(top_k, sources), [F.col("fused_rank")]).select("query_id", "rank", "id", "vector_score", "keyword_score", "fused_score", F.coalesce("max_score", F.lit(0.0)).alias("max_score"))


def with_overviews(hits: DataFrame, overviews: DataFrame, documents: int = 3) -> DataFrame:
    """Overview hits (query_id, id, score), best ``documents``, in front of the others, with fused score 0."""
    o = top(overviews.drop("rank"), documents).select("query_id", F.lit(0).alias("part"), "rank", "id", F.col("score").alias("vector_score"), F.lit(None).cast("double").alias("keyword_score"), F.lit(0.0).alias("fused_score"))
    h = hits.select("query_id", F.lit(1).alias("part"), "rank", "id", "vector_score", "keyword_score", "fused_score")
    both = o.unionByName(h)
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank"))
    return both.select("query_id", n.alias("position"), "part", "id", "vector_score", "keyword_score", "fused_score")


def memory_search(queries: DataFrame, vectors: DataFrame, rows: DataFrame, k: int, least: float = 0.65) -> DataFrame:
    """query_id, rank, kind, source_id, score: of the 3k nearest in the query's repository and kind, those similar enough whose
    row is indexed and ready or saved, one for each (kind, source). rows: id, kind, source_id, state, indexed."""
    near = vector_topk(queries, vectors, min(3 * k, 512), ["repository_id", "kind"]).where(F.col("score") >= least).drop("rank")
    live = near.join(rows.where("indexed and state in ('ready', 'saved')").select("id", "kind", "source_id"), "id")
    best = live.groupBy("query_id", "kind", "source_id").agg(F.max(F.struct("score", (-F.col("id")).alias("m"))).alias("b"))
    return top(best.select("query_id", "kind", "source_id", F.col("b.score").alias("score"), (-F.col("b.m")).alias("id")), k).select("query_id", "rank", "kind", "source_id", "score")


def page_results(ranked: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """query_id, rank, url, title, snippet: of the first 3n ranked chunks, those that exist, best of each URL, renumbered, first n."""
    got = ranked.where(F.col("rank") <= 3 * n).select("query_id", "id", F.col("rank").alias("at")).join(chunks.select("id", "url", "title", "text"), "id")
    best = got.groupBy("query_id", "url").agg(F.min_by(F.struct("title", "text"), "at").alias("c"), F.min("at").alias("at"))
    out = top(best, n, [F.col("at")])
    return out.select("query_id", "rank", "url", F.substring(F.coalesce("c.title", "url"), 1, 512).alias("title"), F.substring("c.text", 1, 10_000).alias("snippet"), F.substring("c.text", 1, 51_200).alias("content"))


def keyset_page(df: DataFrame, keys: list[str], cursor: list | None, n: int, equal: dict | None = None, scope: tuple[str, list] | None = None) -> DataFrame:
    """The page of n rows after a cursor, in key order, with next_cursor on its last row only if more rows follow.

    equal: values that columns must have (a value of None asks nothing); scope: an array column and ids of which it must hold one.
    """
    if not 1 <= n <= 1000:
        raise ValueError("a page has from 1 to 1000 rows")
    for column, value in (equal or {}).items():
        df = df if value is None else df.where(F.col(column) == value)
    if scope is not None:
        kind = df.schema[scope[0]].dataType
        df = df.where(F.arrays_overlap(F.col(scope[0]), F.array(*map(F.lit, scope[1])).cast(kind)))
    if cursor is not None:
        df = df.where(F.struct(*keys) > F.struct(*[F.lit(c).cast(df.schema[k].dataType).alias(k) for k, c in zip(keys, cursor, strict=True)]))
    page = df.orderBy(*keys).limit(n + 1)
    order = Window.orderBy(*keys)  # over at most n + 1 rows
    page = page.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy()))
    cut = F.when((F.col("_r") == n) & (F.col("_n") > n), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    return page.where(F.col("_r") <= n).withColumn("next_cursor", cut).drop("_r", "_n")


def merge_results(results: DataFrame, limit: int) -> DataFrame:
    """request_id, rank, url, title: several result lists of a request by URL key; fused, longest content kept, ties by first seen."""
    r = results.withColumn("key", ux.dedupe_key(F.col("url")))
    seen = F.struct("query_no", "rank")
    longest = F.struct(F.length("content").alias("n"), (-F.col("query_no")).alias("q"), (-F.col("rank")).alias("r"))
    m = r.groupBy("request_id", "key").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("score"), F.min(seen).alias("seen"), F.max_by(F.struct("url", "title"), longest).alias("item"))
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "seen")
    return m.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("request_id", "rank", "item.url", "item.title", "score")


def first_available(results: DataFrame, channels: DataFrame) -> DataFrame:
    """Rows of the first channel with rows, by request. channels: channel, ordinal, local; an explicit request asks local ones last."""
    r = results.join(F.broadcast(channels), "channel")
    priority = F.struct((F.col("explicit") & F.col("local")).alias("late"), F.col("ordinal").alias("o"))
    first = r.groupBy("request_id").agg(F.min(priority).alias("p"))
    return r.join(first, "request_id").where(priority == F.col("p")).select("request_id", "channel", "rank", "url")


def label_sources(hits: DataFrame, documents: int = 5, web: int = 10, offset: int = 0) -> DataFrame:
    """query_id, label: S1.. for the first documents, M1.. for distinct memories, W1.. for web results. hits: query_id, channel, kind, source_id, rank."""
    first = hits.groupBy("query_id", "channel", "kind", "source_id").agg(F.min("rank").alias("rank"))
    n = F.row_number().over(Window.partitionBy("query_id", "channel").orderBy("rank", "kind", "source_id"))
    limit = F.when(F.col("channel") == "S", documents).when(F.col("channel") == "W", web).otherwise(1 << 30)
    start = F.when(F.col("channel") == "W", offset).otherwise(0)
    return first.withColumn("n", n).where(F.col("n") <= limit).select("query_id", F.concat("channel", (F.col("n") + start).cast("string")).alias("label"), "kind", "source_id")


def hit_rate(rankings: DataFrame, gold: DataFrame, k: int = 3) -> DataFrame:
    """channel, kind, queries, hit_rate: share of queries with a gold id among the first k. gold: query_id, kind, id."""
    hit = rankings.where(F.col("rank") <= k).join(gold.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").select("channel", "query_id").distinct().withColumn("hit", F.lit(1))
    channels = rankings.select("channel").distinct()
    asked = gold.select("query_id", "kind").distinct().join(F.broadcast(channels))
    return asked.join(hit, ["channel", "query_id"], "left").groupBy("channel", "kind").agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce("hit", F.lit(0))), DIGITS).alias("hit_rate"))


def score_separability(scores: DataFrame) -> DataFrame:
    """class, statistic, least, median, most, separates: top1, margin, top1 - median, z of each query, by class.

    scores: query_id, class, score. ``separates``: the class's range of the statistic meets no other class's.
    """
    s = scores.groupBy("query_id", "class").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    top1, n = F.element_at("s", 1), F.size("s")
    each = {
        "top1": top1,
        "margin": top1 - F.coalesce(F.get("s", F.lit(1)), F.lit(0.0)),
        "above_median": top1 - F.get("s", F.floor(n / 2).cast("int")),
        "z": (top1 - F.col("mean")) / F.when(F.col("sd") == 0, 1e-9).otherwise(F.col("sd")),
    }
    stats = F.array(*[F.struct(F.lit(k).alias("statistic"), v.alias("v")) for k, v in each.items()])
    rows = s.select("class", F.inline(stats))
    v = F.round("v", DIGITS)
    agg = rows.groupBy("class", "statistic").agg(F.min(v).alias("least"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY round(v, {DIGITS}) DESC)").alias("median"), F.max(v).alias("most"))
    o = agg.select(F.col("class").alias("c2"), "statistic", F.col("least").alias("l2"), F.col("most").alias("m2"))
    meets = agg.join(o, "statistic").where((F.col("class") != F.col("c2")) & (F.col("least") <= F.col("m2")) & (F.col("l2") <= F.col("most"))).select("class", "statistic").distinct().withColumn("meets", F.lit(True))
    return agg.join(meets, ["class", "statistic"], "left").select("class", "statistic", "least", "median", "most", F.col("meets").isNull().alias("separates"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, accumulated in double."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def index_freshness(old: DataFrame, new: DataFrame, least: float = 0.999) -> DataFrame:
    """n, mean, minimum cosine of stored and recomputed vectors (id, embedding); same_source if the minimum reaches ``least``."""
    c = old.select("id", F.col("embedding").alias("a")).join(new.select("id", F.col("embedding").alias("b")), "id").select(cosine(F.col("a"), F.col("b")).alias("c"))
    return c.agg(F.count("*").alias("n"), F.round(F.avg("c"), DIGITS).alias("mean"), F.round(F.min("c"), DIGITS).alias("least"), (F.min("c") >= least).alias("same_source"))
