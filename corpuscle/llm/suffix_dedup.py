"""Suffix-array dedup (op 4): bucket-pointer refinement over routed segments.

Inside a shard all suffixes are first put into buckets by their first 8 bytes, and each suffix points to
its bucket's end. Buckets of more than one suffix are then refined: sorted by the bucket pointers of the suffixes
a fixed offset later, which splits them to twice the depth; the new pointers are used by the next, deeper
refinement at once, so depth goes 8, 16, 32 ... and last to the window's length, by the pointers
of offset (length - depth). Buckets then hold exactly the equal windows of the shard's segments, compared byte by byte.
A window goes if its bucket holds more than one window, or if its segment (told by two 64-bit hashes, see
``repeats``) occurs more than once.

Defined results: null text is empty text; a text shorter than the window keeps all bytes; equal rows are each
other's copies, so they lose every window; removed runs are maximal; matches never cross documents; the kept bytes
need not be valid UTF-8 and are only hashed by the query; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import repeats

WINDOW, GRAM = 400, 48


def bucket_refine(data: np.ndarray, depth: int) -> np.ndarray:
    """Bucket pointer of each suffix: equal exactly if the first ``depth`` bytes are equal (data is padded by zeros at its end)."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    q = min(8, depth)
    word = np.zeros(n, dtype=np.uint64)
    for i in range(q):
        word = (word << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(word)
    pointer = np.empty(n + 1, dtype=np.int64)
    pointer[n] = -1
    _point(pointer, order, word[order], np.arange(n))
    done = q
    while done < depth:
        offset = min(done, depth - done)
        own = pointer[:n]
        size = np.bincount(own, minlength=n)
        active = np.flatnonzero(size[own] > 1)
        if not len(active):
            break
        later = pointer[np.minimum(active + offset, n)] + 1
        key = own[active] * (n + 1) + later
        rank = np.argsort(key)
        active, key = active[rank], key[rank]
        base = own[active]
        # slots of a bucket end at its pointer: the active suffixes, in order, fill them from the bucket's first slot
        first = np.concatenate([[True], base[1:] != base[:-1]])
        begin = np.flatnonzero(first)
        slot = base - size[base] + 1 + np.arange(len(active)) - np.repeat(begin, np.diff(np.append(begin, len(active))))
        _point(pointer, active, key, slot)
        done += offset
    return pointer[:n]


def _point(pointer: np.ndarray, order: np.ndarray, key: np.ndarray, slot: np.ndarray) -> None:
    """Point each suffix of a run of equal keys to the last slot of the run."""
    last = np.append(np.flatnonzero(key[1:] != key[:-1]), len(key) - 1)
    pointer[order] = np.repeat(slot[last], np.diff(np.concatenate([[-1], last])))


def solver(unit: repeats.Bytes, shard: pd.DataFrame) -> list[np.ndarray]:
    """For each distinct segment, which windows occur in another one as well."""
    contents = shard["content"].tolist()
    data = np.frombuffer(b"".join(contents), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(c) for c in contents])])
    pointer = bucket_refine(data, unit.window)
    n = shard["n"].to_numpy(dtype=np.int64)
    at = np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    total = np.bincount(pointer[at], minlength=len(data))
    return np.split(total[pointer[at]] > 1, np.cumsum(n)[:-1])


def _finish(window: int, with_bytes: bool):
    def run(raw: bytes, runs) -> tuple:
        gone = repeats.covered(runs, window, len(raw))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
        return len(raw), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), *([kept] if with_bytes else [])

    return run


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row; with ``with_bytes`` also the kept bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select(repeats.row_key().alias("rk"), F.coalesce("doc_id", F.lit(-1)).alias("doc"), "doc_id", "text")
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    return repeats.removed_by_row(keyed, repeats.Bytes(window, gram), solver, False, _finish(window, with_bytes), schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, unnest(range(1, (length(h) // 2)::BIGINT + 1)) AS i, h FROM d),
w AS (SELECT r, i, substr(h, 2 * i - 1, 2) AS byte, CASE WHEN 2 * (i + {WINDOW - 1}) <= length(h) THEN md5(substr(h, 2 * i - 1, {2 * WINDOW})) END AS win FROM p),
f AS (SELECT r, i, byte, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS rep FROM w),
c AS (SELECT r, i, byte, bool_or(rep) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS edge FROM c),
g AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (edge) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM s GROUP BY r)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g ON d.r = g.r
"""
