"""Queries and SQL of the text family, on ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as fx
from corpuscle.operators import text as op
from corpuscle.sources.tables import spread, table

_CJK = r"[\x{4e00}-\x{9fff}]"
_SEARCH = _CJK + r"|[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+"
_UNIT = _CJK + r"|[A-Za-z0-9_]+|[^\s\p{Z}\p{L}\p{N}_]"
_COUNT = r"[A-Za-z0-9_]+|[^\s\p{Z}\p{L}\p{N}_]"
POSTINGS = f"""tok AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN ['_'] ELSE t END AS t FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SEARCH}') AS t FROM documents)),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(t) AS term, len(t) AS dl FROM tok) GROUP BY 1, 2)"""
STATS = f"""{POSTINGS},
corpus AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM tok),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1)"""

_LINES = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
MARKDOWN = """md AS (SELECT doc_id, '# ' || source || chr(10) || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda s, i:
CASE WHEN length(s) <= 60 AND ends_with(s, '.') THEN CASE WHEN i % 2 = 1 THEN '## ' ELSE '### ' END || s ELSE s END), chr(10) || chr(10)) AS markdown FROM documents)"""


def _docs(spark, d, *cols):
    return spread(table(spark, d, "documents").select(*cols))


def as_markdown(docs: DataFrame) -> DataFrame:
    """Plain documents as Markdown: the source is the title, each line of upper-case shouting or of one short sentence a heading."""
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.when((F.length(s) <= 60) & s.endswith("."), F.concat(F.when(i % 2 == 0, F.lit("## ")).otherwise(F.lit("### ")), s)).otherwise(s))
    return docs.select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n\n"), F.array_join(lines, "\n\n")).alias("markdown"))


def whole_sections(docs: DataFrame) -> DataFrame:
    """Documents without headings as one section each; the source is the title."""
    return docs.select("doc_id", F.col("source").alias("title"), F.lit(0).alias("section_no"), F.array().cast("array<string>").alias("heading_path"), F.col("text").alias("markdown"))


def as_answers(docs: DataFrame) -> DataFrame:
    """Documents as answers that cite: each line ends with the mark of its number, some doubled or repeated."""
    mark = lambda i: F.when(i % 7 == 6, F.concat(F.lit("[[S"), i + 1, F.lit("]]"))).otherwise(F.concat(F.lit("["), F.element_at(F.array(F.lit("S"), F.lit("M"), F.lit("W")), (i % 3 + 1).cast("int")), F.floor(i / 2).cast("int") + 1, F.lit("]")))
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.concat(s, F.lit(" "), mark(i)))
    known = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.concat(F.lit("S"), i))
    return docs.select(F.col("doc_id").alias("answer_id"), F.array_join(lines, "\n").alias("text"), known.alias("source_ids"))


def page_urls_as_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.concat(F.lit("see "), "url", F.lit(", or ("), F.upper("url"), F.lit(") and "), "url", F.lit("。 end.")).alias("text"))


QUERIES = {
    "t1_postings": lambda s, d: op.postings(_docs(s, d, "doc_id", "text"), "doc_id"),
    "t2_token_counts": lambda s, d: op.token_counts(_docs(s, d, "doc_id", "text")),
    "t3_sections": lambda s, d: op.sections(as_markdown(_docs(s, d, "doc_id", "text", "source"))),
    "t4_chunks": lambda s, d: op.chunk_documents(as_markdown(_docs(s, d, "doc_id", "text", "source"))),
    "t5_token_windows": lambda s, d: op.token_windows(_docs(s, d, "doc_id", "text"), "doc_id"),
    "t6_overview_chunks": lambda s, d: op.overview_chunks(whole_sections(_docs(s, d, "doc_id", "text", "source"))),
    "t7_sentences": lambda s, d: op.sentences(_docs(s, d, "doc_id", "text"), "doc_id"),
    "t8_chunk_ids": lambda s, d: op.with_chunk_ids(op.token_windows(_docs(s, d, "doc_id", "text"), "doc_id").withColumnRenamed("doc_id", "document_id").withColumnRenamed("window_no", "chunk_index")).drop("text"),
    "t9_segments": lambda s, d: op.segment_conversations(table(s, d, "conversations").select("conv_id", "turn", "role", "text")),
    "t10_topics": lambda s, d: op.topics(as_markdown(_docs(s, d, "doc_id", "text", "source"))),
    "t11_citations": lambda s, d: op.citations(as_answers(_docs(s, d, "doc_id", "text"))),
    "t12_redact_urls": lambda s, d: op.redact_urls(page_urls_as_text(table(s, d, "pages").select("page_id", "url"))),
    "t13_embed_hash": lambda s, d: op.embed_hash(_docs(s, d, "doc_id", "text")).drop("text"),
    "p6_language": lambda s, d: op.detect_language(_docs(s, d, "doc_id", "text")),
    "p7_intent": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", fx.intent(fx.F.col("text")).alias("intent")),
    "u4_clean_variants": lambda s, d: op.clean_variants(table(s, d, "conversations").selectExpr("conv_id as request_id", "cast(turn as int) as variant_no", "text as query")),
}

_INTENT = "|".join(fx.GLOBAL_INTENT)
_REF = "|".join(fx.DOCUMENT_REFERENCE)
ORACLES = {
    "t1_postings": f"WITH {POSTINGS} SELECT doc_id, term, tf, dl::INTEGER AS dl FROM post",
    "t2_token_counts": f"SELECT doc_id, (len(regexp_extract_all(coalesce(text, ''), '{_CJK}')) + len(regexp_extract_all(coalesce(text, ''), '{_COUNT}')))::BIGINT AS token_count FROM documents",
    "t5_token_windows": f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS t FROM documents)
SELECT doc_id, (i // 700)::INTEGER AS window_no, array_to_string(t[i + 1:i + 800], ' ') AS text, least(800, len(t) - i)::INTEGER AS token_count
FROM (SELECT doc_id, t, unnest(range(0, greatest(1, ceil((len(t) - 100) / 700.0))::BIGINT)) * 700 AS i FROM t WHERE len(t) > 0)""",
    "t6_overview_chunks": r"""SELECT doc_id, -1 AS chunk_index, '文档概览' AS section_path, '标题：' || source || chr(10) || substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 1200) AS text
FROM documents WHERE length(trim(text, e' \t\n\r\f')) > 400""",
    "t7_sentences": r"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::INTEGER - 1 AS sentence_no, s AS sentence FROM (
SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, CASE WHEN len(f) = 0 THEN [text] ELSE f END AS p FROM (SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\S')) AS f FROM documents)))""",
    "t10_topics": f"""WITH {MARKDOWN}, l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(markdown, '{_LINES}'), lambda s: trim(s)), lambda s: starts_with(s, '#') OR starts_with(s, '- ')) AS l FROM md),
n AS (SELECT doc_id, list_filter(list_transform(l, lambda s: trim(regexp_replace(s, '^[#\\- ]+', ''))), lambda s: s <> '')[1:20] AS n FROM l)
SELECT doc_id, unnest(range(len(n)))::INTEGER AS topic_no, unnest(n) AS topic FROM n""",
    "t11_citations": r"""WITH a AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda s, i: s || ' ' || CASE WHEN i % 7 = 0 THEN '[[S' || i || ']]' ELSE '[' || ['S', 'M', 'W'][(i - 1) % 3 + 1] || ((i - 1) // 2 + 1) || ']' END), chr(10)) AS t FROM documents),
m AS (SELECT doc_id, list_filter(regexp_extract_all(t, '\[+[SMW][1-9]\p{Nd}*\]+'), lambda x: NOT starts_with(x, '[[') AND NOT ends_with(x, ']]')) AS m FROM a), u AS (SELECT doc_id, unnest(m) AS x, generate_subscripts(m, 1) AS i FROM m)
SELECT doc_id AS answer_id, (row_number() OVER (PARTITION BY doc_id ORDER BY min(i)))::INTEGER - 1 AS position, substr(x, 2, length(x) - 2) AS source_id FROM u WHERE list_contains(list_transform(range(1, 11), lambda k: '[S' || k || ']'), x) GROUP BY doc_id, x""",
    "p6_language": r"""SELECT doc_id, lang_detected, CASE lang_detected WHEN 'zh' THEN 0.65 WHEN 'en' THEN 0.55 ELSE 0.6 END::DOUBLE AS threshold FROM (SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 'other'
WHEN len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) / length(text) >= 0.2 THEN 'zh' WHEN len(regexp_extract_all(text, '[A-Za-z]')) / length(text) >= 0.5 THEN 'en' ELSE 'other' END AS lang_detected FROM documents)""",
    "p7_intent": f"""SELECT conv_id, turn, CASE WHEN regexp_matches(q, '(?i){_INTENT}') AND (regexp_matches(q, '(?i){_REF}') OR NOT regexp_matches(q, '{fx.CONTENT_ANCHOR}')) THEN 'global' ELSE 'local' END AS intent
FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS q FROM conversations)""",
    "u4_clean_variants": r"""WITH c AS (SELECT conv_id AS request_id, turn::INTEGER AS variant_no, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 200) AS query FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY request_id, lower(query) ORDER BY variant_no) AS r FROM c WHERE query <> ''),
o AS (SELECT request_id, query, row_number() OVER (PARTITION BY request_id ORDER BY variant_no) AS n FROM k WHERE r = 1)
SELECT request_id, n::INTEGER AS position, query FROM o WHERE n <= 3""",
}
ORACLES["t3_sections"] = f"""WITH RECURSIVE {MARKDOWN}, l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split_regex(markdown, '\\r\\n|{_LINES}') AS ls FROM md WHERE markdown IS NOT NULL)),
f AS (SELECT *, sum(CASE WHEN starts_with(line, '```') OR starts_with(line, '~~~') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 AS fence FROM l),
h AS (SELECT *, fence = 0 AND regexp_matches(line, '^#{{1,6}}\\s+.+') AND regexp_matches(line, '^#{{1,6}}\\s+\\S') AS is_h FROM f),
s AS (SELECT *, sum(is_h::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h),
t AS (SELECT doc_id, sec, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(rtrim(trim(regexp_extract(line, '^#+\\s+(.+?)\\s*$', 1)), '#')) AS title FROM s WHERE is_h),
p(doc_id, sec, path) AS (SELECT DISTINCT doc_id, 0::HUGEINT, []::VARCHAR[] FROM l UNION ALL SELECT t.doc_id, t.sec, list_append(p.path[1:t.level - 1], t.title) FROM p JOIN t ON t.doc_id = p.doc_id AND t.sec = p.sec + 1),
m AS (SELECT doc_id, sec, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS markdown FROM s GROUP BY 1, 2)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1)::INTEGER AS section_no, path AS heading_path, markdown FROM m JOIN p USING (doc_id, sec) WHERE markdown <> ''"""
ORACLES["t8_chunk_ids"] = f"""WITH w AS ({ORACLES["t5_token_windows"]}),
h AS (SELECT *, sha1(unhex('{op.NAMESPACE_URL}') || encode(concat_ws(':', doc_id, 'sync', window_no, sha256(text)))) AS h FROM w)
SELECT doc_id AS document_id, window_no AS chunk_index, token_count, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substr('89ab', ((instr('0123456789abcdef', h[17:17]) - 1) & 3)::INTEGER + 1, 1) || h[18:20], h[21:32]) AS chunk_id FROM h"""
ORACLES["t9_segments"] = """WITH RECURSIVE x AS (SELECT conv_id, turn, substr(concat_ws(': ', role, text), 1, 7800) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line) AS n FROM conversations),
f(conv_id, n, seg, held, used) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0, 0, 0::BIGINT FROM x UNION ALL
SELECT conv_id, n, CASE WHEN cut THEN seg + 1 ELSE seg END, CASE WHEN cut THEN 1 ELSE held + 1 END, CASE WHEN cut THEN length(line) ELSE used + length(line) + (held > 0)::INTEGER END FROM
(SELECT f.conv_id, x.n, seg, held, used, line, held > 0 AND (held >= 100 OR used + length(line) + 1 > 7800) AS cut FROM f JOIN x ON x.conv_id = f.conv_id AND x.n = f.n + 1))
SELECT conv_id, seg::INTEGER AS segment_no, min(turn) AS first_turn, max(turn) AS last_turn, string_agg(line, chr(10) ORDER BY n) AS text FROM f JOIN x USING (conv_id, n) GROUP BY 1, 2"""
