"""Substring dedup (op 8): a compressed FM-index for each shard, searched backwards over a wavelet matrix.

A shard holds the segments of some anchors (see ``repeats``), as word numbers with a separator. Its suffixes are
sorted to the window's depth by prefix doubling, the Burrows-Wheeler transform is kept as a wavelet matrix: one
packed bit vector a level with popcount ranks, about log2(words) bits a word. All windows of the
shard's segments are streamed through it: each search goes from the window's last word to its first and narrows an
interval of suffixes by two rank queries; a search ends when its interval holds only itself, and the words matched
so far are the matching statistic of its end. Windows whose statistic reaches the window length report
their interval, and the earliest first occurrence in it decides whether the window also starts earlier.

Defined results: null text has no words; a text of fewer words than the window keeps all; the order of windows is
(doc_id, start), a null doc_id counts as -1; rows of equal doc_id count as one document, so equal rows get equal
results and neither removes the other; kept words are joined by one space; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import repeats
from corpuscle.llm.common import TextBlock

WINDOW, GRAM = 20, 5


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array to at least ``depth`` symbols, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    order, done = np.argsort(rank), 1
    while done < depth:
        later = np.zeros(n, dtype=np.int64)
        later[: max(0, n - done)] = rank[done:]
        key = rank * (n + 2) + later
        order = np.argsort(key)
        key = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[1], 1 + np.cumsum(key[1:] != key[:-1])])
        rank, done = new, 2 * done
        if rank.max() == n:
            break
    return order


class WaveletMatrix:
    """Rank over a sequence of symbols below 2**levels: packed bits, a running count before each 64-bit word."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bits = (seq >> level) & 1
            packed = np.packbits(bits.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, dtype=np.uint8)]).view(np.uint64)
            self.words.append(packed)
            count = np.bitwise_count(packed).astype(np.int64)
            self.before.append((np.cumsum(count) - count).astype(np.int32))
            one = bits.astype(bool)
            self.zeros.append(int(len(seq) - one.sum()))
            seq = np.concatenate([seq[~one], seq[one]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k][word] + np.bitwise_count(self.words[k][word] & mask)

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i lands after all levels for a symbol; rank(symbol, i) = place(symbol, i) - place(symbol, 0)."""
        for k in range(self.levels):
            ones = self._ones(k, i)
            one = (symbol >> (self.levels - 1 - k)) & 1
            i = np.where(one == 1, self.zeros[k] + ones, i - ones)
        return i


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        """text: symbols 0..sigma-1."""
        self.sa = sort_suffixes(text, depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bwt = WaveletMatrix(text[self.sa - 1], sigma)
        self.origin = self.bwt.place(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from those of the patterns: one backward step."""
        base = self.first[symbol] - self.origin[symbol]
        both = self.bwt.place(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return base + both[: len(lo)], base + both[len(lo) :]

    def matching(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the pattern text[s : s + length] of each start: symbols matched from its end while the match occurs
        more than once (at most length), and the interval of the full matches."""
        n = len(starts)
        matched = np.zeros(n, dtype=np.int64)
        full_lo, full_hi = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        alive = np.arange(n)
        lo, hi = np.zeros(n, dtype=np.int64), np.full(n, len(text), dtype=np.int64)
        for k in reversed(range(length)):
            lo, hi = self.extend(text[starts[alive] + k], lo, hi)
            many = hi - lo > 1
            alive, lo, hi = alive[many], lo[many], hi[many]
            matched[alive] += 1
        full_lo[alive], full_hi[alive] = lo, hi
        return matched, full_lo, full_hi


def solver(unit: repeats.Words, shard: pd.DataFrame) -> list[np.ndarray]:
    """For each segment's first occurrence, which windows also start earlier."""
    words = TextBlock(shard["content"].tolist(), False)
    sizes = np.diff(words.off) + 1
    raw = np.zeros(int(sizes.sum()), dtype=np.uint64)  # a zero after each segment
    raw[np.arange(len(words.h)) + np.repeat(np.arange(len(sizes)), sizes - 1)] = words.h
    names, text = np.unique(raw, return_inverse=True)
    text = text.astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = shard["n"].to_numpy(dtype=np.int64)
    inner = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    starts = np.repeat(begin, n) + inner
    index = FMIndex(text, len(names), unit.window)
    matched, lo, hi = index.matching(text, starts, unit.window)
    docs = np.unique(shard["doc"].to_numpy(), return_inverse=True)[1].astype(np.int64)
    own = np.repeat((docs << 32) + shard["start"].to_numpy(dtype=np.int64), n) + inner
    order = np.full(len(text), np.iinfo(np.int64).max)
    order[starts] = own
    flags = np.zeros(len(starts), dtype=bool)
    full = np.flatnonzero(matched == unit.window)
    if len(full):
        intervals, back = np.unique(lo[full], return_inverse=True)
        ends = np.zeros(len(intervals), dtype=np.int64)
        ends[back] = hi[full]
        edges = np.stack([intervals, ends], axis=1).ravel()
        by_rank = np.append(order[index.sa], np.iinfo(np.int64).max)
        earliest = np.minimum.reduceat(by_rank, edges)[::2]
        flags[full] = earliest[back] < own[full]
    return np.split(flags, np.cumsum(n)[:-1])


def _finish(window: int, with_text: bool):
    def run(raw: bytes, runs) -> tuple:
        b = TextBlock([raw], False)
        gone = repeats.covered(runs, window, len(b.h))
        kept = b" ".join([b.raw[i:j] for i, j in zip(b.s[~gone].tolist(), b.e[~gone].tolist(), strict=True)])
        return len(b.h), int(gone.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "replace")] if with_text else [])

    return run


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row; with ``with_text`` also the kept words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select(repeats.row_key().alias("rk"), F.coalesce("doc_id", F.lit(-1)).alias("doc"), "doc_id", "text")
    schema = "n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return repeats.removed_by_row(keyed, repeats.Words(window, gram), solver, True, _finish(window, with_text), schema)


def op8_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, -1) AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT r, k, unnest(range(1, len(ws) + 1)) AS i, ws FROM d),
w AS (SELECT r, k, i, ws[i] AS word, CASE WHEN i + {WINDOW - 1} <= len(ws) THEN md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) END AS win FROM p),
f AS (SELECT r, i, word, win IS NOT NULL AND (k, i) <> first_value((k, i)) OVER (PARTITION BY win ORDER BY k, i) AS rep FROM w),
c AS (SELECT r, i, word, bool_or(rep) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON d.r = g.r
"""
