"""Web sources: links, canonical URLs, scope, robots, frontier, mining, candidate scores, crawl merge and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpuscle.functions import text as tx
from corpuscle.functions import urls as ux
from corpuscle.operators.storage import cut_lineage
from corpuscle.sources.formats import extract_links


def dedupe_pages(pages: DataFrame) -> DataFrame:
    """page_id, url_key, kept: the first page (least id) of each dedupe key is kept. Only ids and keys are shuffled."""
    rows = pages.select("page_id", ux.dedupe_key(F.col("url")).alias("url_key"))
    first = rows.groupBy("url_key").agg(F.min("page_id").alias("first"))
    return rows.join(first, "url_key").select("page_id", "url_key", (F.col("page_id") == F.col("first")).alias("kept"))


def links_in_scope(links: DataFrame, entries: DataFrame) -> DataFrame:
    """links (page_id, link) that lie below some entry (entry: canonical URL).

    A link meets the entries at its own path and at the directories above it, by an equi-join on origin and directory, so a
    host of many links and entries isn't multiplied out.
    """
    bare = F.regexp_replace(ux.scope_prefix(F.col("entry")), "/+$", "")
    e = entries.select(F.concat(ux.origin(F.col("entry")), bare).alias("at"), "entry").distinct()
    parts = F.split(ux.path(F.col("link")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(ux.origin(F.col("link")), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    found = links.select("page_id", "link", F.explode(above).alias("at")).join(e, "at").where(ux.in_scope(F.col("link"), F.col("entry")))
    return found.select("page_id", "link", "entry")


def url_like(value: Column) -> Column:
    """The first http(s) URL in a value, or the value itself if it looks like a bare domain."""
    t = F.trim(value)
    url = F.regexp_extract(t, r"""(?i)https?://[^\s"'<>]+""", 0)
    return F.when(url != "", url).when(t.contains(".") & ~t.contains(":") & ~t.contains(" "), t)


def mine_urls(docs: DataFrame, columns: list[str], order: list[Column], documents: int = 500, urls: int = 500) -> DataFrame:
    """position, url: distinct URLs from the given columns of the newest documents, in order. Both limits are the operator's."""
    newest = docs.orderBy(*order).limit(documents).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    cells = newest.select("_n", F.posexplode(F.array(*columns)).alias("_c", "v")).select((F.col("_n") * len(columns) + F.col("_c")).alias("at"), url_like(F.col("v")).alias("url")).where("url is not null")
    first = cells.groupBy("url").agg(F.min("at").alias("at")).orderBy("at").limit(urls)
    return first.select((F.row_number().over(Window.orderBy("at")) - 1).alias("position"), "url")


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """origin, disallow (array), crawl_delay: the rules in force for an agent. The last User-agent line seen decides; Allow is ignored."""
    lines = F.transform(F.split("body", r"\r\n|\r|\n"), lambda s: F.trim(F.substring_index(s, "#", 1)))
    pairs = F.transform(
        F.filter(lines, lambda s: s.contains(":")),
        lambda s: F.struct(F.lower(F.trim(F.substring_index(s, ":", 1))).alias("k"), F.trim(F.regexp_extract(s, "^[^:]*:(.*)$", 1)).alias("v")),
    )
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("dis"), F.lit(None).cast("double").alias("delay"))

    def step(a: Column, p: Column) -> Column:
        delay = p["v"].try_cast("double")
        return F.struct(
            F.when(p["k"] == "user-agent", (p["v"] == "*") | (F.lower(p["v"]) == agent.lower())).otherwise(a["on"]).alias("on"),
            F.when(a["on"] & (p["k"] == "disallow") & (p["v"] != ""), F.concat(a["dis"], F.array(p["v"]))).otherwise(a["dis"]).alias("dis"),
            F.when(a["on"] & (p["k"] == "crawl-delay") & (delay >= 0), delay).otherwise(a["delay"]).alias("delay"),
        )

    return robots.where("body is not null").select("origin", F.aggregate(pairs, start, step).alias("r")).select("origin", F.col("r.dis").alias("disallow"), F.col("r.delay").alias("crawl_delay"))


def robots_filter(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """url, allowed, crawl_delay: an origin without robots body is denied."""
    u = urls.select("url", ux.origin(F.col("url")).alias("origin"), ux.path(F.col("url")).alias("path"))
    got = u.join(robots_rules(robots, agent), "origin", "left")
    blocked = F.exists("disallow", lambda p: F.col("path").startswith(p))
    return got.select("url", (F.col("disallow").isNotNull() & ~F.coalesce(blocked, F.lit(False))).alias("allowed"), "crawl_delay")


def bfs_frontier(entries: DataFrame, links: DataFrame, max_depth: int, max_pages: int) -> DataFrame:
    """source, url, depth, position, truncated: breadth-first from each entry over in-scope links (from_url, link_no, to_url).

    One join for each level; visited URLs leave by an anti-join; a level is written out before the next. A source keeps
    at most max_pages + 1 URLs on the way: what a later URL leads to comes later still, so no result depends on it.
    """
    seen = cut_lineage(entries.select("source", "entry", F.col("entry").alias("url"), F.lit(0).alias("depth"), F.array(F.lit(0)).alias("via")))
    level = seen
    for depth in range(1, max_depth + 1):
        step = level.join(links, level["url"] == links["from_url"]).where(ux.in_scope(F.col("to_url"), F.col("entry")))
        step = step.select("source", "entry", F.col("to_url").alias("url"), F.lit(depth).alias("depth"), F.concat("via", F.array(F.col("link_no").cast("int"))).alias("via"))
        step = step.groupBy("source", "entry", "url", "depth").agg(F.min("via").alias("via"))
        fresh = step.join(seen.select("source", "url"), ["source", "url"], "left_anti").join(seen.groupBy("source").agg(F.count("*").alias("n")), "source")
        fresh = fresh.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("via", "url")))
        level = cut_lineage(fresh.where(F.col("n") + F.col("r") <= max_pages + 1).select(*step.columns))
        if level.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(level))
    order = Window.partitionBy("source").orderBy("depth", "via", "url")
    ranked = seen.withColumn("position", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("source")))
    return ranked.where(F.col("position") <= max_pages).select("source", "url", "depth", "position", (F.col("n") > max_pages).alias("truncated"))


# Weight of each kind of signal, and bonus for each further kind.
SIGNAL_WEIGHT = {"explicit": 100, "seed": 40, "documents": 30, "nomination": 20, "crawl_history": 15, "upstream": 5}
CORROBORATION = 4


def score_candidates(signals: DataFrame, limit: int) -> DataFrame:
    """signals (value, signal, evidence, label, verified, at) by domain: score, ordered distinct evidence, best metadata.

    Mined signals (documents, crawl_history, upstream) count their URLs in the evidence. ``limit`` is a top-k report.
    """
    rows = signals.select(ux.domain(F.col("value")).alias("domain"), "signal", "evidence", "label", "verified", "at").where("domain is not null")
    mined = F.col("signal").isin("documents", "crawl_history", "upstream")
    per = rows.groupBy("domain", "signal", F.when(~mined, F.col("evidence")).alias("text")).agg(
        F.min("at").alias("at"), F.count("*").alias("n"), F.min("evidence").alias("template"), F.max("verified").alias("verified"), F.min_by("label", F.when(F.col("label").isNotNull(), F.struct(~F.col("verified"), F.col("at")))).alias("label")
    )
    weight = F.create_map(*[F.lit(x) for kv in SIGNAL_WEIGHT.items() for x in kv])
    shown = F.when(F.col("text").isNull(), F.concat("template", F.lit(" ("), "n", F.lit(")"))).otherwise(F.col("text"))
    best = per.groupBy("domain").agg(
        (F.max(weight[F.col("signal")]) + CORROBORATION * (F.size(F.collect_set("signal")) - 1)).alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", shown.alias("e")))), lambda x: x["e"]), "; ").alias("evidence"),
        F.min_by("label", F.when(F.col("label").isNotNull(), F.struct(~F.col("verified"), F.col("at")))).alias("label"),
        F.max("verified").alias("verified"),
    )
    return best.orderBy(F.desc("score"), "domain").limit(limit)


def merge_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by domain (domain, evidence array, label, verified): ordered union of evidence, new non-null values win, verified by or."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    merged = both.groupBy("domain").agg(
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_new", "evidence"))), lambda x: x["evidence"]))).alias("evidence"),
        F.max_by("label", F.when(F.col("label").isNotNull(), F.col("_new"))).alias("label"),
        F.bool_or("verified").alias("verified"),
    )
    return merged


# Reasons by error code, by probe state and by status.
ERROR_REASON = {
    "CRAWL_SCOPE_REJECTED": "scope_rejected",
    "SCOPE_REJECTED": "scope_rejected",
    "ROBOTS_DENIED": "robots_denied",
    "UNSUPPORTED_MEDIA": "unsupported_media",
    "CRAWL_RATE_LIMITED": "limit_reached",
    "DOCUMENT_TOO_LARGE": "limit_reached",
}
STATES = ("unreachable", "throttled", "http_rejected", "geo_blocked", "tls_error", "proxy_error")
REASONS = (*STATES, "scope_rejected", "robots_denied", "unsupported_media", "limit_reached", "fetch_failed")


def rejection_reason(error: Column, status: Column, probe: Column, stored: Column) -> Column:
    """A stored reason that is known; else error code, then status, then probe state, then fetch_failed."""
    by_error = F.create_map(*[F.lit(x) for kv in ERROR_REASON.items() for x in kv])[error]
    by_status = F.when(status == 451, "geo_blocked").when(status.isin(429, 503), "throttled").when(status >= 400, "http_rejected").when(status.isNotNull(), "fetch_failed")
    known = F.when(stored.isin(*REASONS), stored)
    return F.coalesce(known, by_error, F.when(stored.isNull(), F.coalesce(by_status, F.when(probe.isin(*STATES), probe))), F.lit("fetch_failed"))


def classify_rejections(log: DataFrame) -> DataFrame:
    return log.withColumn("reason", rejection_reason(F.col("error_code"), F.col("status"), F.col("probe_state"), F.col("stored_reason")))


def crawl_diagnostics(log: DataFrame, shown: int = 200) -> DataFrame:
    """batch_id, total, first rejected URLs (by URL, at most ``shown``), dominant: the most common reason, first seen on ties, null if a page survived.

    log: batch_id, at, url, reason (null for a page that survived). Reasons are counted before anything is ranked.
    """
    counts = log.where("reason is not null").groupBy("batch_id", "reason").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    top = counts.groupBy("batch_id").agg(F.sum("n").alias("total"), F.max_by("reason", F.struct("n", (-F.col("first")).alias("f"))).alias("dominant"))
    kept = log.groupBy("batch_id").agg(F.count_if(F.col("reason").isNull()).alias("survived"))
    order = Window.partitionBy("batch_id").orderBy("url", "at")
    first = log.where("reason is not null").withColumn("r", F.row_number().over(order)).where(F.col("r") <= shown)
    urls = first.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "url"))), lambda x: x["url"]).alias("u"))
    out = kept.join(top, "batch_id", "left").join(urls, "batch_id", "left")
    return out.select("batch_id", F.coalesce("total", F.lit(0)).alias("total"), F.when(F.col("survived") == 0, F.col("dominant")).alias("dominant"), F.coalesce(F.size("u"), F.lit(0)).alias("n_shown"), F.element_at("u", 1).alias("first_url"))


def corpus_stats(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """domain, pages, chunks, last_fetched: a domain of either table."""
    p = pages.groupBy("domain").agg(F.count("*").alias("pages"), F.max("fetched_at").alias("last_fetched"))
    c = chunks.groupBy("domain").agg(F.count("*").alias("chunks"))
    out = p.join(c, "domain", "full_outer")
    return out.select("domain", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("chunks", F.lit(0)).alias("chunks"), "last_fetched")


def crawl_merge(pages: DataFrame, fetches: DataFrame) -> DataFrame:
    """url, action, sha256: kept (304 or same hash), updated, removed (404 or 410 of a known page), untouched, failed (unknown page).

    pages: url, sha256; fetches: url, status, sha256; one row for each url in both. Of etag, last_modified and fetched_at those
    columns that both tables have are merged too: an updated page takes the fetch's; a kept one its time, and of the other two what
    the fetch gives (null or empty: the page's own); an untouched one stays as it is.
    """
    marks = [c for c in ("etag", "last_modified", "fetched_at") if c in pages.columns and c in fetches.columns]
    p = pages.select("url", F.col("sha256").alias("old"), F.lit(True).alias("known"), *(F.col(c).alias(f"old_{c}") for c in marks))
    f = fetches.select("url", "status", F.col("sha256").alias("new"), F.lit(True).alias("fetched"), *(F.col(c).alias(f"new_{c}") for c in marks))
    out = p.join(f, "url", "full_outer")
    action = (
        F.when(F.col("fetched").isNull(), "untouched")
        .when(F.col("known") & ((F.col("status") == 304) | ((F.col("status") == 200) & (F.col("new") == F.col("old")))), "kept")
        .when((F.col("status") == 200) & F.col("new").isNotNull(), "updated")
        .when(F.col("known") & F.col("status").isin(404, 410), "removed")
        .otherwise(F.when(F.col("known"), "untouched").otherwise("failed"))
    )
    out = out.withColumn("action", action)
    state = F.col("action")

    def merged(c: str) -> Column:
        old, new = F.col(f"old_{c}"), F.col(f"new_{c}")
        given = new if c == "fetched_at" else F.coalesce(F.when(new != "", new), old)
        return F.when(state == "updated", new).when(state == "kept", given).when(state == "untouched", old).alias(c)

    sha = F.when(state == "updated", F.col("new")).when(state.isin("kept", "untouched"), F.col("old"))
    return out.select("url", "action", sha.alias("sha256"), *map(merged, marks))


def merge_chunks(chunks: DataFrame, merged: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """The columns of ``chunks`` and ``state``: kept, added or deleted.

    Pages that are updated or removed lose their chunks and updated ones get those of ``new_chunks``; a chunk whose id is among
    those again is only added. chunks, new_chunks: chunk_id, url, more; merged: url, action. The chunks that stand after the merge are
    the kept and added ones; the ids of the deleted ones are what a vector index has to drop.
    """
    actions = merged.select("url", "action")
    old = chunks.join(actions, "url", "left").withColumn("state", F.when(F.col("action").isin("updated", "removed"), "deleted").otherwise("kept"))
    fresh = new_chunks.join(actions.where("action = 'updated'").select("url"), "url", "left_semi").withColumn("state", F.lit("added"))
    gone = old.where("state = 'deleted'").join(fresh.select("chunk_id"), "chunk_id", "left_anti")
    columns = [*chunks.columns, "state"]
    return old.where("state = 'kept'").select(*columns).unionByName(fresh.select(*columns)).unionByName(gone.select(*columns))


def parse_nominations(outputs: DataFrame, limit: int = 5, chars: int = 200) -> DataFrame:
    """id, position, domain, reason: the first JSON array of a model's text, as strings or objects; distinct domains, first kept."""
    raw = F.regexp_extract("text", r"(?s)\[.*\]", 0)
    items = F.from_json(raw, T.ArrayType(T.StringType()))
    rows = outputs.select("id", F.posexplode(items).alias("at", "item")).where("item is not null")
    is_object = F.col("item").startswith("{")
    name = F.when(is_object, F.get_json_object("item", "$.domain")).otherwise(F.col("item"))
    reason = tx.collapse(F.when(is_object, F.get_json_object("item", "$.reason")))
    rows = rows.select("id", "at", ux.domain(name).alias("domain"), F.when(reason != "", F.substring(reason, 1, chars)).alias("reason")).where("domain is not null")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("id", "domain").orderBy("at"))).where("r = 1")
    n = F.row_number().over(Window.partitionBy("id").orderBy("at"))
    return first.select("id", n.alias("position"), "domain", "reason").where(F.col("position") <= limit)


def match_topics(texts: DataFrame, topics: DataFrame, limit: int = 3) -> DataFrame:
    """id, rank, topic: topics by number of keywords that occur in the text without case, then declaration order.

    topics (topic, ordinal, keywords) is a small declared table; each text is read once against all of it, so no pairs of text and topic are shuffled.
    """
    listed = F.broadcast(topics.agg(F.collect_list(F.struct("ordinal", "topic", "keywords")).alias("_topics")))
    low = F.lower("text")
    hits = F.transform("_topics", lambda t: F.struct((-F.size(F.filter(t["keywords"], lambda k: low.contains(F.lower(k))))).alias("h"), t["ordinal"].alias("o"), t["topic"].alias("topic")))
    best = F.slice(F.array_sort(F.filter(hits, lambda h: h["h"] < 0)), 1, limit)
    return texts.join(listed).select("id", F.posexplode(best).alias("rank", "b")).select("id", (F.col("rank") + 1).alias("rank"), "b.topic", (-F.col("b.h")).alias("hits"))
