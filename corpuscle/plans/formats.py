"""Queries of formats and streaming, on ``pages``, ``documents`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import col as C

from corpuscle.operators import storage as st
from corpuscle.plans import maintenance as mt
from corpuscle.plans import web as wb
from corpuscle.plans.text import MARKDOWN, as_markdown
from corpuscle.sources import formats as fm
from corpuscle.sources.tables import spread, table
from corpuscle.streaming import jobs
from corpuscle.streaming.state import KeyedState


def _files(s, d):
    """Documents as Markdown files, some with a BOM or broken bytes, and pages as HTML files, with a few unknown types."""
    m = as_markdown(spread(table(s, d, "documents").select("doc_id", "text", "source")))
    bom, bad = F.unhex(F.lit("EFBBBF")), F.unhex(F.lit("FF"))
    head = F.when(F.col("doc_id") % 5 == 0, bom).when(F.col("doc_id") % 17 == 3, bad).otherwise(F.unhex(F.lit("")))
    md = m.select(F.concat(F.lit("/docs/"), "doc_id", F.lit(".md")).alias("path"), F.when(F.col("doc_id") % 29 == 1, "image/gif").otherwise("text/markdown").alias("media_type"), F.concat(head, F.encode("markdown", "UTF-8")).alias("content"))
    page = table(s, d, "pages").select(F.concat(F.lit("/pages/"), "page_id", F.lit(".html")).alias("path"), F.lit("text/html").alias("media_type"), F.encode("html", "UTF-8").alias("content"))
    return md.unionByName(page)


def _with_images(s, d):
    """Pages have no images, so each link becomes one: lazy, srcset, tiny or svg by its number."""
    p = table(s, d, "pages").select("page_id", "url", "html")
    img = r"""<img width="$1" src="$1.png" srcset="$1-s.png 100w, $1-l.png 900w">"""
    lazy = r"""<img data-src="$1.svg" src="data:x"><img src="$1.png" width="20">"""
    return p.withColumn("html", F.when(F.col("page_id") % 2 == 0, F.regexp_replace("html", r'<a href="([^"]*)">', img)).otherwise(F.regexp_replace("html", r'<a href="([^"]*)">', lazy)))


def _stream(s, df: DataFrame, files: int) -> DataFrame:
    """The rows of a table as a file stream."""
    path = st.shared_folder(s)
    df.repartition(files).write.parquet(path)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, files // 2)).parquet(path)


def _drain(s, stream: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    """Run a stream over all there is and read what it wrote; in update mode the last row of each key counts."""
    out, check = st.shared_folder(s), st.shared_folder(s)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(out)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = s.read.parquet(out)
    if key:
        rest = [c for c in got.columns if c not in (*key, "_epoch")]
        got = got.groupBy(*key).agg(*[F.max_by(c, "_epoch").alias(c) for c in rest])
    return got.drop("_epoch")


def _sessions(s, d):
    """Closed sessions of the stream; a closing message for each user, far later, closes them all."""
    e = table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    end = e.groupBy("user_id").agg(F.lit("2030-01-01").cast("timestamp").alias("ts"))
    first = st.shared_folder(s)
    e.write.parquet(first)
    end.write.mode("append").parquet(first)
    stream = s.readStream.schema(e.schema).parquet(first)
    return _drain(s, jobs.stream_sessions(stream), "append").where("start < '2030-01-01'")


def _backoff(s, d):
    a = mt._attempts(s, d).withColumn("ts", C("ts").cast("timestamp"))
    path = st.shared_folder(s)
    a.write.parquet(path)
    out, check = st.shared_folder(s), st.shared_folder(s)
    found = jobs.stream_backoff(s.readStream.schema(a.schema).parquet(path), forget_s=2 * 86_400)
    found.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
    return s.read.parquet(out)


def _ending(s, d):
    """Events as messages; every 40th ends its user's conversation."""
    return table(s, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 40 == 7).alias("ends"))


def _summaries(s, d):
    """The last change of each session summary in a stream; the newest file has a message far later for each user, which closes all sessions."""
    e = _ending(s, d)
    first = st.shared_folder(s)
    e.repartition(3).write.parquet(first)
    e.groupBy("user_id").agg(F.lit(-1).cast("long").alias("event_id"), F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(False).alias("ends")).write.mode("append").parquet(first)
    changes = _drain(s, jobs.stream_summaries(s.readStream.schema(e.schema).parquet(first)), "append")
    # the closing message makes a user's last summary stale, unless the conversation has ended
    closing = changes.where("start < '2030-01-01'")
    last = closing.groupBy("user_id").agg(F.max("start").alias("start"), F.lit(True).alias("is_last"))
    out = closing.groupBy("user_id", "start").agg(*(F.max_by(c, "state").alias(c) for c in ("due", "messages", "reason", "state")))
    out = out.join(last, ["user_id", "start"], "left")
    return out.select("user_id", "start", "due", "messages", "reason", F.when(F.col("is_last"), "ready").otherwise(F.col("state")).alias("state"))


def _sync(s, d):
    remote, prior, _, _ = mt._snapshots(s, d)
    state = KeyedState(st.shared_folder(s), prior, ["document_id"], buckets=16)
    out = st.shared_folder(s)
    jobs.stream_sync(_stream(s, remote, 4), state, lambda df, _: df.select("document_id", "action").write.mode("append").parquet(out), st.shared_folder(s)).awaitTermination()
    return s.read.parquet(out)


def _corpus(s, d):
    """Pages and chunks after a stream of fetches; fetches repeat the page's text, updated ones with a word more."""
    known, chunks, fetches = wb._crawled(s, d)
    pages = KeyedState(st.shared_folder(s), known, ["url"], buckets=16)
    held = KeyedState(st.shared_folder(s), chunks, ["url", "chunk_id"], ["url"], buckets=16)
    jobs.stream_corpus(_stream(s, fetches, 4), pages, held, wb._chunked, st.shared_folder(s)).awaitTermination()
    return pages, held


def _letters(texts: list[str]) -> list[list[float]]:
    return [[float(t.count(c)) for c in "aeiou"] for t in texts]


QUERIES = {
    "s1_markdown": lambda s, d: fm.read_markdown(_files(s, d).where("path like '/docs/%'")).select("path", "title", "reject", F.md5("text").alias("text_md5")),
    "s2_pages": lambda s, d: fm.extract_pages(table(s, d, "pages").select("page_id", "html")),
    "s4_images": lambda s, d: fm.extract_images(_with_images(s, d)),
    "f1_formats": lambda s, d: fm.parse_files(_files(s, d)).select("path", "title", "reject", F.length("text").alias("n_chars")),
    "f2_embedder": lambda s, d: fm.embed_with(table(s, d, "documents").select("doc_id", "text"), _letters, 5).drop("text"),
    "r1_stream_sessions": _sessions,
    "r2_stream_sync": _sync,
    "r1_stream_summaries": _summaries,
    "r3_stream_corpus": lambda s, d: _corpus(s, d)[0].current().select("url", "sha256"),
    "r3_stream_chunks": lambda s, d: _corpus(s, d)[1].current().drop("text"),
    "r4_stream_backoff": _backoff,
    "r5_stream_progress": lambda s, d: _drain(s, jobs.stream_progress(_stream(s, mt._items(s, d).select("batch_id", "state"), 4)), "update", ["batch_id"]),
}

ORACLES = {
    "s1_markdown": f"""WITH {MARKDOWN}, f AS (SELECT doc_id, source, markdown, doc_id % 5 <> 0 AND doc_id % 17 = 3 AS bad FROM md JOIN documents USING (doc_id))
SELECT '/docs/' || doc_id || '.md' AS path, CASE WHEN NOT bad THEN source END AS title, CASE WHEN bad THEN 'undecodable' END AS reject, CASE WHEN NOT bad THEN md5(markdown) END AS text_md5 FROM f""",
    "f2_embedder": "SELECT doc_id, list_transform(['a', 'e', 'i', 'o', 'u'], lambda c: (length(text) - length(replace(text, c, '')))::FLOAT) AS embedding FROM documents",
    "r1_stream_sessions": mt.ORACLES["r1_sessions"],
    "r1_stream_summaries": mt.ORACLES["r1_summaries"],
    "r3_stream_chunks": wb.ORACLES["j10_chunk_merge"].replace("SELECT chunk_id, url, window_no, token_count, state FROM r", "SELECT chunk_id, url, window_no, token_count FROM r WHERE state <> 'deleted'"),
    "r2_stream_sync": f"WITH {mt._SNAP} SELECT r.i AS document_id, CASE WHEN p.i IS NULL THEN 'added' ELSE 'changed' END AS action FROM re r LEFT JOIN pr p ON p.i = r.i WHERE (r.title, r.h, r.path) IS DISTINCT FROM (p.title, p.h, p.path)",
    "r3_stream_corpus": "SELECT url, sha256 FROM (" + wb.ORACLES["j10_page_merge"] + ") WHERE action IN ('kept', 'updated', 'untouched')",
    "r4_stream_backoff": mt.ORACLES["w4_backoff_forget"],
    "r5_stream_progress": f"WITH {mt._ITEMS} SELECT batch_id, count(*) AS total, count(*) FILTER (state = 'COMPLETED') AS completed, count(*) FILTER (state = 'FAILED') AS failed, count(*) FILTER (state = 'SKIPPED') AS skipped, count(*) FILTER (state = 'CANCELLED') AS cancelled FROM it GROUP BY 1",
}
