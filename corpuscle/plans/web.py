"""Queries and SQL of the web family, on ``pages``, ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.functions import urls as ux
from corpuscle.operators import text as tx
from corpuscle.operators import web as op
from corpuscle.plans import text as tp
from corpuscle.sources.tables import spread, table

AGENT = "corpusbot"


def _pages(s, d, *cols):
    return spread(table(s, d, "pages").select(*(cols or ("page_id", "url", "html"))))


def _canonical(s, d):
    return _pages(s, d, "page_id", "url").select("page_id", ux.canonical_url(F.col("url")).alias("url")).where("url is not null")


def _links(s, d):
    l = op.extract_links(_pages(s, d)).join(_canonical(s, d).withColumnRenamed("url", "from_url"), "page_id")
    return l.groupBy("from_url", F.col("link").alias("to_url")).agg(F.min("link_no").alias("link_no"))


def _robots(s, d):
    """Each page's first links as the rules of its origin, so that rules follow the pages."""
    l = op.extract_links(_pages(s, d)).where("link_no < 2")
    rule = F.concat(F.lit("User-agent: *\nDisallow: "), F.array_join(F.sort_array(F.collect_set(ux.path(F.col("link")))), "\nDisallow: "), F.lit("\nCrawl-delay: 2\nUser-agent: other\nDisallow: /"))
    return l.groupBy(ux.origin(F.col("link")).alias("origin")).agg(rule.alias("body"))


def _signals(s, d):
    p = _pages(s, d, "page_id", "url")
    base = p.select(F.col("url").alias("value"), F.when(F.col("page_id") % 3 == 0, "documents").when(F.col("page_id") % 3 == 1, "crawl_history").otherwise("upstream").alias("signal"), F.lit("mined").alias("evidence"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("verified"), (F.col("page_id") + 1_000_000).alias("at"))
    seed = p.where("page_id % 10 = 0").select(F.col("url").alias("value"), F.lit("seed").alias("signal"), F.concat(F.lit("seed "), "page_id").alias("evidence"), F.concat(F.lit("label "), "page_id").alias("label"), F.lit(True).alias("verified"), F.col("page_id").alias("at"))
    return base.unionByName(seed)


def _log(s, d):
    """Events as a crawl log: a user is a batch, the type gives the status."""
    e = table(s, d, "events").select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("at"), F.concat(F.lit("https://h.test/"), "event_id").alias("url"), "event_type", "value")
    status = F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "click", 404).when(F.col("event_type") == "signup", 451).when(F.col("event_type") == "purchase", 429)
    code = F.when((F.col("event_type") == "view") & (F.col("value") > 20), "ROBOTS_DENIED").when(F.col("value") > 90, "UNKNOWN")
    return e.select("batch_id", "at", "url", code.alias("error_code"), status.alias("status"), F.when(F.col("at") % 5 == 0, "unreachable").alias("probe_state"), F.when(F.col("at") % 11 == 0, "tls_error").when(F.col("at") % 13 == 0, "gone").alias("stored_reason"))


def _fetches(p):
    status = F.element_at(F.array(*map(F.lit, (200, 304, 404, 200, 500, 410))), (F.pmod("page_id", F.lit(6)) + 1).cast("int"))
    h = F.sha2(F.concat("url", F.when(F.col("page_id") % 6 == 3, "new").otherwise("")), 256)
    return p.where("page_id % 4 <> 1").select("url", status.alias("status"), F.when(status == 200, h).alias("sha256"))


def _chunked(pages):
    """chunk_id, url, window_no, text, token_count of pages (url, text); an id names place and content."""
    return tx.token_windows(pages, "url").withColumn("chunk_id", F.sha2(F.concat_ws(":", "url", "window_no", "text"), 256))


def _crawled(s, d):
    """(pages, their chunks, fetches): pages with validators, fetches with texts of 200s; a changed page has a word more."""
    c = _canonical(s, d).groupBy("url").agg(F.min("page_id").alias("page_id"))
    html = _pages(s, d, "page_id", "html")
    stamp = lambda day: F.timestamp_seconds(F.col("page_id") + day * 86_400)
    base = c.where("page_id % 5 <> 2")
    pages = base.select("url", F.sha2("url", 256).alias("sha256"), F.concat(F.lit("e"), "page_id").alias("etag"), stamp(1).alias("fetched_at"))
    chunks = _chunked(base.join(html, "page_id").select("url", F.col("html").alias("text")))
    tag = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("n"), "page_id")).when(F.col("page_id") % 4 == 2, "")
    fetches = _fetches(c).join(c.join(html, "page_id"), "url")
    text = F.when(F.col("status") == 200, F.concat("html", F.when(F.col("page_id") % 6 == 3, " renewed").otherwise("")))
    return pages, chunks, fetches.select("url", "status", "sha256", text.alias("text"), tag.alias("etag"), stamp(2).alias("fetched_at"))


def _page_merge(s, d):
    pages, _, fetches = _crawled(s, d)
    return op.crawl_merge(pages, fetches)


def _chunk_merge(s, d):
    pages, chunks, fetches = _crawled(s, d)
    merged = op.crawl_merge(pages, fetches)
    new = _chunked(fetches.where("text is not null").select("url", "text"))
    return op.merge_chunks(chunks, merged, new).drop("text")


def _topics(s):
    rows = [("law", 0, ["the", "that", "of"]), ("kunst", 1, ["der", "und", "sch"]), ("vie", 2, ["que", "pour", "dans"]), ("ocio", 3, ["los", "para", "que"])]
    return s.createDataFrame(rows, "topic string, ordinal int, keywords array<string>")


QUERIES = {
    "p2_canonical_url": lambda s, d: _pages(s, d, "page_id", "url").select("page_id", ux.canonical_url(F.col("url")).alias("canonical")),
    "p3_dedupe_pages": lambda s, d: op.dedupe_pages(_pages(s, d, "page_id", "url")),
    "p4_domains": lambda s, d: _pages(s, d, "page_id", "url").select("page_id", ux.domain(F.col("url")).alias("domain")),
    "p5_in_scope": lambda s, d: op.links_in_scope(op.extract_links(_pages(s, d)), _canonical(s, d).select(F.regexp_replace("url", r"[^/]*$", "").alias("entry"))),
    "s3_links": lambda s, d: op.extract_links(_pages(s, d)),
    "s7_mine_urls": lambda s, d: op.mine_urls(_pages(s, d, "page_id", "url").withColumn("named", F.concat(F.lit("web:"), "url")).withColumn("bare", ux.domain(F.col("url"))), ["named", "url", "bare"], [F.desc("page_id")]),
    "j6_robots": lambda s, d: op.robots_filter(_canonical(s, d).select("url"), _robots(s, d), AGENT),
    "j8_frontier": lambda s, d: op.bfs_frontier(_canonical(s, d).select(F.col("page_id").alias("source"), F.col("url").alias("entry")), _links(s, d), 2, 10),
    "a2_corpus_stats": lambda s, d: op.corpus_stats(
        _pages(s, d, "page_id", "url").select(ux.domain(F.col("url")).alias("domain"), F.col("page_id").alias("fetched_at")).where("domain is not null"), op.extract_links(_pages(s, d)).select(ux.domain(F.col("link")).alias("domain")).where("domain is not null")
    ),
    "a4_candidates": lambda s, d: op.score_candidates(_signals(s, d), 20),
    "a5_merge_sources": lambda s, d: op.merge_sources(*[_signals(s, d).where(f"signal {x} 'seed'").groupBy(ux.domain(F.col("value")).alias("domain")).agg(F.sort_array(F.collect_set("evidence")).alias("evidence"), F.max("label").alias("label"), F.bool_or("verified").alias("verified")) for x in ("<>", "=")]),
    "p8_rejections": lambda s, d: op.classify_rejections(_log(s, d)).select(F.col("at").alias("event_id"), "reason"),
    "a7_diagnostics": lambda s, d: op.crawl_diagnostics(op.classify_rejections(_log(s, d)).withColumn("reason", F.when((F.col("batch_id") % 4 == 0) & (F.col("at") % 50 == 0), F.lit(None)).otherwise(F.col("reason")))),
    "j10_crawl_merge": lambda s, d: op.crawl_merge(_canonical(s, d).where("page_id % 5 <> 2").select("url", F.sha2("url", 256).alias("sha256")), _fetches(_canonical(s, d))),
    "j10_page_merge": _page_merge,
    "j10_chunk_merge": _chunk_merge,
    "s6_nominations": lambda s, d: op.parse_nominations(
        _pages(s, d, "page_id", "url").groupBy((F.col("page_id") % 50).alias("id")).agg(F.concat(F.lit("Sure: "), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: F.struct(x["url"].alias("domain"), F.concat(F.lit("page  "), x["page_id"]).alias("reason")))), F.lit(" done")).alias("text"))
    ),
    "j7_topics": lambda s, d: op.match_topics(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), _topics(s)),
}

# a canonical URL in SQL, from a column u
_CANON = r"""CASE WHEN regexp_matches(u, '^(?i:https?)://[^/?#]+') AND NOT contains(regexp_extract(u, '^(?i:https?)://([^/?#]*)', 1), '@') THEN
lower(regexp_extract(u, '^((?i:https?))://', 1)) || '://' || regexp_replace(regexp_replace(lower(regexp_extract(u, '^(?i:https?)://([^/?#]*)', 1)), CASE WHEN lower(u) LIKE 'https%' THEN ':443$' ELSE ':80$' END, ''), ':$', '')
|| coalesce(nullif(regexp_extract(u, '^(?i:https?)://[^/?#]*([^?#]*)', 1), ''), '/')
|| coalesce('?' || nullif(array_to_string(list_transform(list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_.*|gclid|fbclid)$')),
 lambda p: replace(url_encode(url_decode(replace(split_part(p, '=', 1), '+', ' '))), '%20', '+') || '=' || replace(url_encode(url_decode(replace(CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END, '+', ' '))), '%20', '+')), '&'), ''), '') END"""
_KEY = r"""lower(regexp_extract(u, '^((?i:https?))://', 1)) || '://' || regexp_replace(regexp_replace(lower(regexp_extract(u, '^(?i:https?)://([^/?#]*)', 1)), '^www\.', ''), ':$', '')
|| coalesce(nullif(regexp_replace(regexp_extract(u, '^(?i:https?)://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/')
|| coalesce('?' || nullif(array_to_string(list_transform(list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_.*|fbclid|gclid|msclkid|spm|ref|ref_src|source|from)$')),
 lambda p: replace(url_encode(url_decode(replace(split_part(p, '=', 1), '+', ' '))), '%20', '+') || '=' || replace(url_encode(url_decode(replace(CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END, '+', ' '))), '%20', '+')), '&'), ''), '')"""
_DOMAIN = r"""CASE WHEN regexp_matches(h, '^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+$') AND regexp_matches(h, '\.[a-z]+$') AND NOT regexp_matches(h, '\.(local|internal|localhost)$') THEN h END"""
_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(u, '//([^/?#]*)', 1)), '\.+$', ''), '^www\.', '')"
_P = f"c AS (SELECT page_id, u AS raw, {_CANON} AS url FROM (SELECT page_id, url AS u FROM pages))"
_LINK = (
    r"""h AS (SELECT page_id, url AS base, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS link_no FROM (SELECT page_id, url, regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS hs FROM pages)),
r AS (SELECT page_id, link_no, replace(trim(href), '&amp;', '&') AS x, base, regexp_extract(base, '^((?i:https?)://[^/?#]*)', 1) AS root, regexp_extract(base, '^([^?#]*)', 1) AS here FROM h),
a AS (SELECT page_id, link_no, CASE WHEN regexp_matches(x, '^(?i:https?)://') THEN x WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN x LIKE '//%' THEN split_part(base, '//', 1) || x WHEN x LIKE '/%' THEN root || x
 WHEN x LIKE '?%' THEN here || x WHEN x = '' OR x LIKE '#%' THEN regexp_extract(base, '^([^#]*)', 1) || x ELSE CASE WHEN here = root THEN root || '/' ELSE regexp_replace(here, '[^/]*$', '') END || x END AS u FROM r),
l AS (SELECT page_id, link_no::INTEGER AS link_no, """
    + _CANON
    + " AS link FROM a), links AS (SELECT * FROM l WHERE link IS NOT NULL)"
)
_SIG = f"""sig AS (SELECT url AS u, CASE page_id % 3 WHEN 0 THEN 'documents' WHEN 1 THEN 'crawl_history' ELSE 'upstream' END AS signal, 'mined' AS evidence, NULL AS label, false AS verified, page_id + 1000000 AS pos FROM pages
UNION ALL SELECT url, 'seed', 'seed ' || page_id, 'label ' || page_id, true, page_id FROM pages WHERE page_id % 10 = 0),
dom AS (SELECT * FROM (SELECT *, {_DOMAIN} AS domain FROM (SELECT *, {_HOST} AS h FROM sig)) WHERE domain IS NOT NULL)"""
_LOGSQL = """log AS (SELECT user_id AS batch_id, event_id AS pos, 'https://h.test/' || event_id AS url, CASE WHEN event_type = 'view' AND value > 20 THEN 'ROBOTS_DENIED' WHEN value > 90 THEN 'UNKNOWN' END AS error_code,
CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 404 WHEN 'signup' THEN 451 WHEN 'purchase' THEN 429 END AS status, CASE WHEN event_id % 5 = 0 THEN 'unreachable' END AS probe, CASE WHEN event_id % 11 = 0 THEN 'tls_error' WHEN event_id % 13 = 0 THEN 'gone' END AS stored FROM events),
rej AS (SELECT *, CASE WHEN stored = 'tls_error' THEN stored WHEN error_code = 'ROBOTS_DENIED' THEN 'robots_denied' WHEN stored IS NOT NULL THEN 'fetch_failed' WHEN status = 451 THEN 'geo_blocked' WHEN status IN (429, 503) THEN 'throttled' WHEN status >= 400 THEN 'http_rejected'
WHEN probe IS NOT NULL THEN probe ELSE 'fetch_failed' END AS reason FROM log)"""

ORACLES = {
    "p2_canonical_url": f"WITH {_P} SELECT page_id, url AS canonical FROM c",
    "p3_dedupe_pages": f"WITH k AS (SELECT page_id, {_KEY} AS url_key FROM (SELECT page_id, url AS u FROM pages)) SELECT page_id, url_key, page_id = min(page_id) OVER (PARTITION BY url_key) AS kept FROM k",
    "p4_domains": f"SELECT page_id, {_DOMAIN} AS domain FROM (SELECT page_id, {_HOST} AS h FROM (SELECT page_id, url AS u FROM pages))",
    "p5_in_scope": f"""WITH {_P}, {_LINK}, e AS (SELECT DISTINCT regexp_replace(url, '[^/]*$', '') AS entry FROM c WHERE url IS NOT NULL)
SELECT page_id, link, entry FROM links JOIN e ON starts_with(link, regexp_extract(entry, '^(https?://[^/?#]*)', 1)) AND regexp_extract(link, '^(https?://[^/?#]*)', 1) = regexp_extract(entry, '^(https?://[^/?#]*)', 1)
AND (starts_with(regexp_extract(link, '^https?://[^/?#]*([^?#]*)', 1), regexp_extract(entry, '^https?://[^/?#]*([^?#]*)', 1)) OR regexp_extract(link, '^https?://[^/?#]*([^?#]*)', 1) = rtrim(regexp_extract(entry, '^https?://[^/?#]*([^?#]*)', 1), '/'))""",
    "s3_links": f"WITH {_LINK} SELECT page_id, link_no, link FROM links",
    "s7_mine_urls": f"""WITH d AS (SELECT *, row_number() OVER (ORDER BY page_id DESC) AS n FROM pages ORDER BY page_id DESC LIMIT 500),
v AS (SELECT n * 3 AS pos, url AS u FROM d UNION ALL SELECT n * 3 + 1, url FROM d UNION ALL SELECT n * 3 + 2, {_DOMAIN} FROM (SELECT n, {_HOST} AS h FROM (SELECT n, url AS u FROM d))),
f AS (SELECT u AS url, min(pos) AS pos FROM v WHERE u IS NOT NULL GROUP BY 1 ORDER BY 2 LIMIT 500) SELECT (row_number() OVER (ORDER BY pos))::INTEGER - 1 AS position, url FROM f""",
    "a2_corpus_stats": f"""WITH {_LINK}, p AS (SELECT {_DOMAIN} AS domain, page_id FROM (SELECT page_id, {_HOST} AS h FROM (SELECT page_id, url AS u FROM pages))),
k AS (SELECT {_DOMAIN} AS domain FROM (SELECT {_HOST} AS h FROM (SELECT link AS u FROM links))),
pa AS (SELECT domain, count(*) AS pages, max(page_id) AS last_fetched FROM p WHERE domain IS NOT NULL GROUP BY 1), pb AS (SELECT domain, count(*) AS chunks FROM k WHERE domain IS NOT NULL GROUP BY 1)
SELECT domain, coalesce(pages, 0) AS pages, coalesce(chunks, 0) AS chunks, last_fetched FROM pa FULL JOIN pb USING (domain)""",
    "a4_candidates": f"""WITH {_SIG}, per AS (SELECT domain, signal, CASE WHEN signal = 'seed' THEN evidence ELSE 'mined (' || count(*) || ')' END AS e, min(pos) AS pos, max(verified) AS verified, arg_min(label, pos) AS label FROM dom GROUP BY domain, signal, evidence)
SELECT domain, (max(CASE signal WHEN 'seed' THEN 40 WHEN 'documents' THEN 30 WHEN 'crawl_history' THEN 15 ELSE 5 END) + 4 * (count(DISTINCT signal) - 1))::INTEGER AS score, string_agg(e, '; ' ORDER BY pos, e) AS evidence,
arg_min(label, pos) FILTER (label IS NOT NULL) AS label, max(verified) AS verified FROM per GROUP BY domain ORDER BY score DESC, domain LIMIT 20""",
    "a5_merge_sources": f"""WITH {_SIG}, o AS (SELECT domain, signal = 'seed' AS new, list_sort(list(DISTINCT evidence)) AS evidence, max(label) AS label, max(verified) AS verified FROM dom GROUP BY 1, 2)
SELECT coalesce(a.domain, b.domain) AS domain, list_concat(coalesce(a.evidence, []), coalesce(b.evidence, [])) AS evidence, coalesce(b.label, a.label) AS label, coalesce(a.verified, false) OR coalesce(b.verified, false) AS verified
FROM (SELECT * FROM o WHERE NOT new) a FULL JOIN (SELECT * FROM o WHERE new) b ON a.domain = b.domain""",
    "p8_rejections": f"WITH {_LOGSQL} SELECT pos AS event_id, reason FROM rej",
    "a7_diagnostics": f"""WITH {_LOGSQL}, g AS (SELECT batch_id, pos, url, CASE WHEN NOT (batch_id % 4 = 0 AND pos % 50 = 0) THEN reason END AS reason FROM rej),
k AS (SELECT batch_id, reason, count(*) AS n, min(pos) AS f FROM g WHERE reason IS NOT NULL GROUP BY 1, 2), t AS (SELECT batch_id, sum(n)::BIGINT AS total, first(reason ORDER BY n DESC, f) AS dominant FROM k GROUP BY 1)
SELECT g.batch_id, coalesce(any_value(total), 0) AS total, CASE WHEN count(*) FILTER (reason IS NULL) = 0 THEN any_value(dominant) END AS dominant, least(200, count(reason))::INTEGER AS n_shown, min(url) FILTER (reason IS NOT NULL) AS first_url FROM g LEFT JOIN t ON t.batch_id = g.batch_id GROUP BY 1""",
    "j10_crawl_merge": f"""WITH {_P}, p AS (SELECT url, sha256(url) AS old FROM c WHERE url IS NOT NULL AND page_id % 5 <> 2), s AS (SELECT url, page_id, [200, 304, 404, 200, 500, 410][page_id % 6 + 1] AS status FROM c WHERE url IS NOT NULL AND page_id % 4 <> 1),
f AS (SELECT url, status, CASE WHEN status = 200 THEN sha256(url || CASE WHEN page_id % 6 = 3 THEN 'new' ELSE '' END) END AS new FROM s),
m AS (SELECT coalesce(p.url, f.url) AS url, old, new, CASE WHEN status IS NULL THEN 'untouched' WHEN old IS NOT NULL AND (status = 304 OR (status = 200 AND new = old)) THEN 'kept' WHEN status = 200 THEN 'updated'
WHEN old IS NOT NULL AND status IN (404, 410) THEN 'removed' WHEN old IS NOT NULL THEN 'untouched' ELSE 'failed' END AS action FROM p FULL JOIN f ON p.url = f.url)
SELECT url, action, CASE WHEN action = 'updated' THEN new WHEN action IN ('kept', 'untouched') THEN old END AS sha256 FROM m""",
    "s6_nominations": f"""WITH n AS (SELECT page_id % 50 AS id, page_id AS pos, {_DOMAIN} AS domain, 'page ' || page_id AS reason FROM (SELECT page_id, {_HOST} AS h FROM (SELECT page_id, url AS u FROM pages))),
k AS (SELECT *, row_number() OVER (PARTITION BY id, domain ORDER BY pos) AS r FROM n WHERE domain IS NOT NULL), o AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS position, domain, reason FROM k WHERE r = 1) SELECT id, position::INTEGER AS position, domain, reason FROM o WHERE position <= 5""",
    "j7_topics": """WITH t AS (SELECT * FROM (VALUES ('law', 0, ['the', 'that', 'of']), ('kunst', 1, ['der', 'und', 'sch']), ('vie', 2, ['que', 'pour', 'dans']), ('ocio', 3, ['los', 'para', 'que'])) v(topic, o, k)),
h AS (SELECT doc_id AS id, topic, o, len(list_filter(k, lambda x: contains(lower(text), x))) AS hits FROM documents, t), r AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY hits DESC, o))::INTEGER AS rank, topic, hits::INTEGER AS hits FROM h WHERE hits > 0)
SELECT * FROM r WHERE rank <= 3""",
}
_MERGED = ORACLES["j10_crawl_merge"].rsplit("SELECT url, action", 1)[0].replace(", p AS", ", o AS (SELECT url, min(page_id) AS page_id FROM c GROUP BY url), p AS", 1).replace("FROM c WHERE", "FROM o WHERE")
ORACLES["j10_page_merge"] = f"""{_MERGED} SELECT m.url, action, CASE WHEN action = 'updated' THEN new WHEN action IN ('kept', 'untouched') THEN old END AS sha256,
CASE action WHEN 'updated' THEN tag WHEN 'kept' THEN coalesce(nullif(tag, ''), 'e' || page_id) WHEN 'untouched' THEN 'e' || page_id END AS etag,
CASE WHEN action IN ('updated', 'kept') THEN make_timestamp((page_id + 172800) * 1000000) WHEN action = 'untouched' THEN make_timestamp((page_id + 86400) * 1000000) END AS fetched_at
FROM m JOIN (SELECT url, page_id, CASE page_id % 4 WHEN 0 THEN 'n' || page_id WHEN 2 THEN '' END AS tag FROM o) x ON x.url = m.url"""
_WINDOWS = f"""SELECT url, side, (i // 700)::INTEGER AS window_no, least(800, len(t) - i)::INTEGER AS token_count, sha256(concat_ws(':', url, i // 700, array_to_string(t[i + 1:i + 800], ' '))) AS chunk_id
FROM (SELECT url, side, t, unnest(range(0, greatest(1, ceil((len(t) - 100) / 700.0))::BIGINT)) * 700 AS i FROM (SELECT url, side, regexp_extract_all(text, '{tp._UNIT}') AS t FROM x) WHERE len(t) > 0)"""
ORACLES["j10_chunk_merge"] = f"""{_MERGED}, x AS (SELECT m.url, 'old' AS side, html AS text FROM m JOIN o ON o.url = m.url JOIN pages USING (page_id) WHERE old IS NOT NULL
UNION ALL SELECT m.url, 'new', html || CASE WHEN page_id % 6 = 3 THEN ' renewed' ELSE '' END FROM m JOIN o ON o.url = m.url JOIN pages USING (page_id) WHERE action = 'updated'),
w AS ({_WINDOWS}), n AS (SELECT chunk_id FROM w WHERE side = 'new'),
r AS (SELECT w.*, CASE WHEN side = 'new' THEN 'added' WHEN action IN ('updated', 'removed') THEN 'deleted' ELSE 'kept' END AS state FROM w JOIN m ON m.url = w.url
WHERE side = 'new' OR action NOT IN ('updated', 'removed') OR chunk_id NOT IN (SELECT chunk_id FROM n))
SELECT chunk_id, url, window_no, token_count, state FROM r"""
ORACLES["j6_robots"] = f"""WITH {_P}, {_LINK}, parts AS (SELECT regexp_extract(link, '^([a-z]+://[^/]*)', 1) AS origin, regexp_extract(link, '^[a-z]+://[^/]*([^?#]*)', 1) AS path FROM links WHERE link_no < 2),
rules AS (SELECT origin, list(DISTINCT path) AS disallow FROM parts GROUP BY 1), u AS (SELECT url, regexp_extract(url, '^([a-z]+://[^/]*)', 1) AS origin, regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS path FROM c WHERE url IS NOT NULL)
SELECT url, disallow IS NOT NULL AND len(list_filter(disallow, lambda p: starts_with(u.path, p))) = 0 AS allowed, CASE WHEN disallow IS NOT NULL THEN 2.0::DOUBLE END AS crawl_delay FROM u LEFT JOIN rules ON rules.origin = u.origin"""
