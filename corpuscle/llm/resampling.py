"""Importance resampling of documents towards a target's hashed n-gram distribution (op 13).

Features are runs of one and two words, hashed by crc32 into buckets. One pass over the documents and one over the target count
the buckets (a task sends one count for each bucket); the log ratios form an array of integers, which scores each document in a
second pass by look-up. Gumbel noise from a hash of the id turns the draw without replacement into taking the highest scores.

The k-th highest is found by distributed quickselect on the composite key (score, id, row): random rows of the interval left are
pivots, one pass counts the rows before, at and behind each of them exactly, and the interval that holds the k-th key is searched
again. Only pivots and counts come to the driver. Rows up to that key are the winners; they alone are sorted, by ranges, and ranked.

Defined results: null text has no words; documents of fewer than ``least`` words are scored but never drawn; equal scores go to
the smaller id, rows without id first (they are hashed as the empty id) and rows with the same id in any order; each row is scored and
drawn by itself, repeated rows too; an empty table gives an empty result, an empty target gains from its smoothing alone; a word or
text of any length counts whole (a long text is read in stretches); other columns of the input are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpuscle.llm.common import materialise
from corpuscle.llm.lexemes import Lexemes, runs

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 7, 20, 25
#: Pivots of a round of the quickselect.
PIVOTS = 31
#: Words of more bytes are hashed one by one.
LONG = 64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """crc32 is linear: what a byte adds when k bytes follow it, and what start and end add to n bytes."""
    after = np.empty((LONG + 1, 256), dtype=np.uint32)
    after[0] = np.arange(256)
    for _ in range(8):
        after[0] = after[0] >> 1 ^ (after[0] & 1) * np.uint32(0xEDB88320)
    for k in range(LONG):
        after[k + 1] = after[k] >> 8 ^ after[0][after[k] & 255]
    state, frame = 0xFFFFFFFF, np.empty(2 * LONG + 2, dtype=np.uint32)
    for n in range(len(frame)):
        frame[n] = state ^ 0xFFFFFFFF
        state = state >> 8 ^ int(after[0][state & 255])
    return after, frame


_AFTER, _FRAME = _tables()


def crc_features(lex: Lexemes) -> tuple[np.ndarray, np.ndarray]:
    """crc32 of each word, and of each word with the next one (joined by a space; also across texts, for the caller to drop)."""
    size = lex.e - lex.s
    if not len(size):
        return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.uint32)
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(first - lex.s, size)
    left = np.minimum(np.repeat(lex.e, size) - 1 - at, LONG)
    raw = np.bitwise_xor.reduceat(_AFTER[left, lex.data[at]], first)
    n = np.minimum(size, LONG)
    one = raw ^ _FRAME[n]
    head, gap = raw[:-1].astype(np.uint64), n[1:] + 1  # the first word's part moves by the second one's bytes and the space
    two = (head >> (8 * np.minimum(gap, 4)).astype(np.uint64)).astype(np.uint32)
    for i in range(4):
        byte = (head >> np.uint64(8 * i)).astype(np.uint8)
        two ^= np.where(gap > i, _AFTER[np.maximum(gap - 1 - i, 0), byte], np.uint32(0))
    two ^= _AFTER[n[1:], 0x20] ^ raw[1:] ^ _FRAME[n[:-1] + 1 + n[1:]]
    word = lambda i: lex.data[lex.s[i] : lex.e[i]].tobytes()
    for i in np.flatnonzero(size > LONG).tolist():
        one[i] = zlib.crc32(word(i))
        for j in (i - 1, i):
            if 0 <= j < len(two):
                two[j] = zlib.crc32(word(j) + b" " + word(j + 1))
    return one, two


def _features(texts: list[bytes | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(owner, bucket, number of words among them) of a run's features, words first."""
    for owner, lap, lex in runs(texts):
        one, two = crc_features(lex)
        part = np.repeat(np.arange(len(owner)), np.diff(lex.off))
        heads = lex.off[:-1][lap]
        fresh = np.ones(len(one), dtype=bool)
        fresh[heads] = False  # counted at the end of the stretch before
        whole = part[:-1] == part[1:]
        who = owner[part]
        yield np.concatenate([who[fresh], who[1:][whole]]), np.concatenate([one[fresh], two[whole]]) % buckets, int(fresh.sum())


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket (buckets without any are left out)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, bucket, _ in _features(batch.column(0).cast(pa.binary()).to_pylist(), buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket's smoothed share in the target and in the documents; ``buckets`` rows at most are collected."""
    s, t = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    for table, out in ((raw, s), (target, t)):
        for bucket, n in table.collect():
            out[bucket] = n
    in_s, in_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b + 1) * in_s) / (float(a + 1) * in_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_features, weight of each row: the floored mean gain of its features."""
    schema = pa.schema([pa.field(key, to_arrow_type(docs.schema[key].dataType)), *(pa.field(c, pa.int64()) for c in ("n_words", "n_features", "weight"))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, total = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for owner, bucket, n in _features(batch.column(1).cast(pa.binary()).to_pylist(), len(gain)):
                np.add.at(total, owner, gain[bucket])
                words += np.bincount(owner[:n], minlength=len(words))
                features += np.bincount(owner, minlength=len(words))
            weight = total // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight))], schema=schema)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(score, f"`{key}` {kind}, n_words long, n_features long, weight long")


def perturbed(weight: Column, key: Column, seed: int = SEED) -> Column:
    """weight plus Gumbel noise in thousandths, from the first 32 bits of sha256("seed:key"); a null key counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def kth(rows: DataFrame, keys: list[str], k: int, pivots: int = PIVOTS):
    """The k-th (from 1) smallest key of ``rows``, a written table with columns ``keys`` that together are unique, by quickselect.

    Each round draws pivots from the open interval (low, high) by a hash that changes with the round, and counts in one pass.
    """
    key, low, high, skipped, seed = F.struct(*keys), None, None, 0, 0
    value = lambda row: F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(keys, row, strict=True)))
    while True:
        left = rows
        if low is not None:
            left = left.where((key > value(low)) & (F.col(keys[0]) >= low[0]))
        if high is not None:
            left = left.where((key < value(high)) & (F.col(keys[0]) <= high[0]))
        drawn = [tuple(r) for r in left.select(*keys).orderBy(F.xxhash64(F.lit(seed), *keys)).limit(pivots).collect()]
        ordered = sorted(drawn, key=lambda row: tuple((v is not None, v) for v in row))
        marks = F.array(*map(value, ordered))
        before, at = F.size(F.filter(marks, lambda p: p < key)), F.array_contains(marks, key)
        counts = {(r["before"], r["at"]): r["n"] for r in left.groupBy(before.alias("before"), at.alias("at")).agg(F.count("*").alias("n")).collect()}
        for i in range(len(ordered) + 1):
            inside = counts.get((i, False), 0)
            if k <= skipped + inside:
                low, high = ordered[i - 1] if i else low, ordered[i] if i < len(ordered) else high
                break
            skipped += inside + 1
            if k == skipped:
                return ordered[i], value(ordered[i])
        seed += 1


def draw(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, key: str = "doc_id") -> DataFrame:
    """``scored`` (key, n_words, score, more) with ``rank``: 1, 2, ... of the percent of rows drawn, null of the others."""
    spark = scored.sparkSession
    rows = materialise(scored.withColumn("_down", -F.col("score")).withColumn("_row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= least
    k = rows.where(able).count() * percent // 100
    undrawn = F.lit(None).cast("long").alias("rank")
    if not k:
        return rows.select(*scored.columns, undrawn)
    order = ["_down", key, "_row"]
    _, last = kth(rows.where(able), order, k)
    won = able & (F.struct(*order) <= last)
    ranged = rows.where(won).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    sizes, before = [], 0
    for part, first, n in sorted(ranged.groupBy("_part").agg(F.min("_at"), F.count("*")).collect()):  # a row for each range
        sizes.append((part, before - first))
        before += n
    shift = F.broadcast(spark.createDataFrame(sizes, "_part int, _shift long"))
    ranked = ranged.join(shift, "_part").select(*scored.columns, (F.col("_at") + F.col("_shift") + 1).alias("rank"))
    return ranked.unionByName(rows.where(~F.coalesce(won, F.lit(False))).select(*scored.columns, undrawn))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_features, weight, score, rank of each row of ``docs``, drawn towards the texts of ``target``."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weigh(docs, gain, key)
    return draw(scored.withColumn("score", perturbed(F.col("weight"), F.col(key), seed)), percent, least, key)


def selected(docs: DataFrame, drawn: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id was drawn, with their rank; ids are expected to be unique."""
    return docs.join(drawn.where("rank is not null").select(key, "rank"), key)


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
