"""WARC archives and their capture index (op 6).

Writing: each page is a WARC/1.1 record. Of pages with equal payloads of at least MIN_REVISIT bytes, the one of
largest page_id is a response and the others are revisit records without a body that refer to it. The records
go through Spark's text writer, whose line separator is the two CRLFs that end a record, so archives land in
any file system Spark can write. Pages are written by size class, and each class has as many records to an archive as keep it
below about ARCHIVE_BYTES, since an archive is read whole; a larger page has an archive of its own.

Reading: archives are read as binary files and cut by their Content-Length headers. Each archive gives a capture
run, sorted locally by URL key and timestamp. Runs are written out, dealt by ranges of (URL key, timestamp,
page_id, archive, place), and each range is merged from its runs with a loser tree: k-way, one comparison a
level for each row. Ranges follow each other, so partitions are in global order and hold
each URL's capture history in time order. There is a range for about RANGE_ROWS rows, whatever the cluster's settings, and
as the range key ends in the record's place, neither a hot URL nor a page repeated many times fills one. Rows of one run come
together in run order (Spark sorts by archive and place in the run, and spills).

Defined results: null html is an empty payload; null url has no target header and an empty URL key; pages of
equal payload and equal largest page_id (repeated rows) are all responses; a null page_id counts as smallest;
other columns of the input are ignored; an empty table gives an empty result. Pages have no fetch time: the
capture time is the given base plus page_id seconds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm.common import materialise, shared_dir

MIN_REVISIT = 1000
#: About the most bytes of an archive, and the most bytes of a record in each size class but the last.
ARCHIVE_BYTES, CLASSES = 32 << 20, (16 << 10, 256 << 10, 4 << 20)
#: Most records of an archive, and rows of an index range.
RECORDS_PER_FILE, RANGE_ROWS = 2_000, 50_000
#: Most repeated digests that are broadcast (about 100 bytes each).
BROADCAST_DIGESTS = 200_000
EPOCH = 1_704_067_200  # 2024-01-01T00:00:00Z
CRLF = "\r\n"
_HTTP = CRLF.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "", ""))
_URN = "urn:corpuscle:page:"


def _header(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Only digests are grouped (with map-side combine). The repeated digests are written and counted: up to
    BROADCAST_DIGESTS of them are broadcast, so no payload is shuffled; more are joined by a shuffle that Spark splits
    at hot digests.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    same = rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    same = materialise(same)
    few = same.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    rows = rows.join(F.broadcast(same) if few else same, "payload_digest", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")) & (F.col("payload_bytes") >= MIN_REVISIT)
    return rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("_first"))).drop("_first")


def record(base: int = EPOCH) -> Column:
    """The text of a record without the two CRLFs that end it."""
    revisit = F.col("record_type") == "revisit"
    urn = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    date = F.date_format(F.timestamp_seconds(F.coalesce(F.col("page_id"), F.lit(0)) + base), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    block = F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), "payload"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", urn(F.col("page_id"))),
        F.when(F.col("url").isNotNull(), _header("WARC-Target-URI", url)).otherwise(F.lit("")),
        _header("WARC-Date", date),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(
            revisit,
            F.concat(
                _header("WARC-Refers-To", urn(F.col("refers_to"))),
                _header("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                _header("X-Payload-Length", F.col("payload_bytes").cast("string")),
            ),
        ).otherwise(F.lit("")),
        _header("Content-Type", "application/http; msgtype=response"),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    ).alias("value")


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives below path, a folder for each size class that the pages have (one without records for an empty table)."""
    rows = with_record_types(pages)
    # headers and URL come to less than the class limit beside the payload; revisits have no payload
    weight = F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes")) + F.octet_length(F.coalesce("url", F.lit("")))
    size = F.lit(len(CLASSES))
    for k, most in reversed(list(enumerate(CLASSES))):
        size = F.when(weight <= most - 1024, k).otherwise(size)
    rows = rows.withColumn("size_class", size)
    for k in sorted(r[0] for r in rows.select("size_class").distinct().collect()) or [0]:
        records = min(RECORDS_PER_FILE, max(1, archive_bytes // CLASSES[k])) if k < len(CLASSES) else 1
        rows.where(F.col("size_class") == k).select(record()).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records).text(f"{path}/class-{k}")


def url_key(url: str | None) -> str:
    """Sort-friendly key: reversed host, then path and query; lower case, scheme, www and fragment dropped."""
    try:
        u = urlsplit((url or "").lower())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return (url or "").lower()
    return ",".join(reversed(host.split("."))) + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def parse(content: bytes) -> Iterator[dict]:
    """The records of an archive: headers, place in the file, payload digest and size taken from the payload itself."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split(CRLF)
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        block = memoryview(content)[end + 4 : end + 4 + size]
        number = lambda name: int(x) if (x := head[name][len(_URN) + 1 : -1]) else None
        row = {"offset": at, "length": end + 4 + size - at, "url": head.get("WARC-Target-URI"), "captured": head["WARC-Date"], "page_id": number("WARC-Record-ID"), "record_type": head["WARC-Type"]}
        if row["record_type"] == "revisit":
            row |= {"payload_bytes": int(head["X-Payload-Length"]), "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number("WARC-Refers-To")}
        else:
            payload = block[len(_HTTP) :]
            row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "refers_to": None}
        yield row
        at = end + 4 + size + 4


_INDEX = "url_key string, captured string, page_id long, archive string, offset long, length long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, seq int"
_COLUMNS = [c.split()[0] for c in _INDEX.split(", ")]


def _sort_key(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2]


def _runs(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            run = sorted(((url_key(r["url"]), r["captured"], r["page_id"], path, r["offset"], r["length"], r["url"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in parse(content)), key=_sort_key)
            out = pd.DataFrame([(*r, i) for i, r in enumerate(run)], columns=_COLUMNS)
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The index rows of all archives below path; rows of one archive are a run, sorted by ``seq``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(_runs, _INDEX)


class LoserTree:
    """k-way merge of sorted lists: an inner node keeps the loser of its match, the winner goes on up."""

    def __init__(self, runs: list[list], key: Callable):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.keys = [[key(x) for x in r] for r in runs]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i, building=True)

    def _beats(self, a: int, b: int) -> bool:
        """Run a's head comes before run b's; a finished run loses; ties go to the earlier run."""
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.keys[a][self.at[a]], self.keys[b][self.at[b]]
        return x < y or x == y and a < b

    def _play(self, i: int, building: bool = False) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.k:
            w = self.losers[0]
            if self.at[w] >= len(self.runs[w]):
                return
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self._play(w)


def _merge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [f for f in it if len(f)]
    if not frames:
        return
    rows = pd.concat(frames, ignore_index=True)
    frames.clear()
    ids = rows[["page_id", "refers_to"]].astype("Int64")
    rows[["page_id", "refers_to"]] = ids.astype(object).where(ids.notna(), None)
    runs = [list(g.itertuples(index=False, name=None)) for _, g in rows.groupby("archive", sort=True)]
    part: list[tuple] = []
    for row in LoserTree(runs, _sort_key):
        part.append(row)
        if len(part) == 10_000:
            yield pd.DataFrame(part, columns=_COLUMNS).astype({"page_id": "Int64", "refers_to": "Int64"})
            part = []
    if part:
        yield pd.DataFrame(part, columns=_COLUMNS).astype({"page_id": "Int64", "refers_to": "Int64"})


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index rows in global order of URL key, timestamp and page_id: one range to a partition, in order.

    The runs should be a written table: they are counted, and range bounds are found by a first pass.
    """
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))
    return runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "archive", "seq").sortWithinPartitions("archive", "seq").mapInPandas(_merge, _INDEX)


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    runs = materialise(capture_runs(spark, path))
    return merge_runs(runs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= {MIN_REVISIT} GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first IS NOT NULL AND d.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first IS NOT NULL AND d.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
