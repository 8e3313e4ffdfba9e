"""Benchmark decontamination (op 3): CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items are folded (A-Z lower, ASCII punctuation and white space to single spaces) and read as characters. A CGK
walk emits at each step the GRAM-character gram under a pointer and moves the pointer by one, and by one
more if a random bit of (step, gram) says so; two walks over strings at small edit distance meet again after each
edit, so edit distance becomes Hamming distance of what they emit.

A window starts at every word of the text and at every word of an item. It is as long as the item from that word on
(up to STEPS steps, about 125 characters; the item's later words start windows of their own), so each is met
by as many windows as it has words. Each table samples SAMPLED steps near each other, since agreement comes in
runs between edits; RANGES says how many tables sample from which steps, and a window is in those tables whose
steps it reaches. A pair that agrees in a table and in more than about the root of its steps is
a candidate, and is verified exactly: least edit distance, in characters, between the item and any part of the text
around the candidate, at most (1 - similarity) of the item's length. No candidate is dropped; before that, one is passed over
only if none of the item's parts of up to 64 characters is within its share of the edits, which a match can't have.

Recall is set for the threshold itself: at 20 % random character or word edits the tests ask for 0.9 against an exact
search. Edits spread as evenly as can be (one every five characters, nowhere four intact ones) are the worst case;
README gives figures.

The items are the stated query set: they are taken in blocks of ITEM_BLOCK, so what is broadcast is bounded
however many there are; each block is one pass over the texts without a shuffle, and a text costs
the same whatever its source or copies.

Defined results: null or empty text or item matches nothing, nor does an item without letters or digits; equal items each
match; a repeated document row gives its matches again; items of fewer than SHORT characters are met only as a
whole and exactly, between spaces; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least similarity, 1 - distance / length of the item, of a match.
SIMILARITY = 0.8
GRAM, STEPS, SAMPLED, SPAN = 3, 85, 4, 8
#: (first step, end, tables) and, for items of fewer than FEW steps, the same with two samples.
RANGES, FEW, FEW_RANGE = ((0, 42, 18), (42, STEPS, 10)), 30, (0, 9, 10)
#: Folded characters below which an item is matched exactly.
SHORT = 12
#: Items broadcast at a time.
ITEM_BLOCK = 2_000
#: Bytes of text that are walked together.
BLOCK = 1 << 21
#: Windows walked at a time.
_CHUNK = 32_768

_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
_ODD = np.random.default_rng(20240607).integers(1, 1 << 31, size=STEPS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MUL = np.uint32(0x9E3779B1)


def _samples() -> list[tuple[np.ndarray, bool]]:
    """(steps, whether for short windows) of each table."""
    rng, out = np.random.default_rng(4), []
    for (a, b, tables), sampled, short in [*((r, SAMPLED, False) for r in RANGES), (FEW_RANGE, 2, True)]:
        for _ in range(tables):
            first = int(rng.integers(a, b - SPAN))
            out.append((np.concatenate([[first], first + 1 + np.sort(rng.choice(SPAN, sampled - 1, replace=False))]), short))
    return out


_TABLES = _samples()


def least_agreement(steps: np.ndarray) -> np.ndarray:
    """Agreeing steps from which a pair is verified; unrelated text seldom has more than the root of its steps."""
    return (1.25 * np.sqrt(steps)).astype(np.int64) + 1


def fold(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Folded texts, each after a zero byte, with single spaces; and where each begins, with the end."""
    raw = np.frombuffer(b"\0" + b"\0".join([t.translate(_FOLD) for t in texts]), dtype=np.uint8)
    blank = raw <= 32
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = (raw[1:] != 32) | ~blank[:-1]
    data = raw[keep]
    return data, np.append(np.flatnonzero(data == 0) + 1, len(data) + 1)


def grams(data: np.ndarray) -> np.ndarray:
    """Odd 32-bit hash of the gram at each byte, padded for the walks that begin before the end."""
    d = np.concatenate([data, np.zeros(2 * STEPS + GRAM + 2, dtype=np.uint8)]).astype(np.uint32)
    g = d[: len(d) - GRAM + 1].copy()
    for k in range(1, GRAM):
        g *= np.uint32(0x01000193)
        g ^= d[k : k + len(g)]
    g *= _MUL
    g ^= g >> np.uint32(15)
    g *= np.uint32(0x85EBCA6B)
    g ^= g >> np.uint32(13)
    g |= np.uint32(1)
    return g


def word_starts(data: np.ndarray) -> np.ndarray:
    blank = data <= 32
    return (np.flatnonzero(blank[:-1] & ~blank[1:]) + 1).astype(np.int32)


def walk(g: np.ndarray, starts: np.ndarray, steps: int, at: np.ndarray | None = None) -> np.ndarray:
    """CGK embedding of the windows: the gram hash met at each step, shape (steps, windows); its place goes to ``at``."""
    pos, out = starts.astype(np.int32), np.empty((steps, len(starts)), dtype=np.uint32)
    bit = np.empty(len(starts), dtype=np.uint32)
    for j in range(steps):
        if at is not None:
            at[j] = pos
        np.take(g, pos, out=out[j], mode="clip")
        np.multiply(out[j], _ODD[j], out=bit)
        bit >>= np.uint32(31)
        pos += bit.view(np.int32)
        pos += 1
    return out


def _key(e: np.ndarray, sample: np.ndarray) -> np.ndarray:
    k = e[sample[0]] * _MUL
    for j in sample[1:]:
        k += e[j]
        k *= _MUL
    return k


class _Tables:
    """The windows of the items and the tables over them. An item: its number and its folded bytes."""

    def __init__(self, items: list[tuple[int, bytes]]):
        parts, number, offset, reach, few = [], [], [], [], []
        for i, text in items:
            data, _ = fold([text])
            starts = word_starts(data)
            at = np.empty((STEPS, len(starts)), dtype=np.int32)
            e = walk(grams(data), starts, STEPS, at)
            steps = (at + GRAM <= len(data)).sum(axis=0)
            long = np.flatnonzero((steps >= min(42, steps[0] // 2)) & (steps > 0))
            e[np.arange(STEPS)[:, None] >= steps] = 0  # beyond the item; no gram's hash is zero
            parts.append(e[:, long])
            number.append(np.full(len(long), i))
            offset.append(starts[long] - 1)
            reach.append(steps[long])
            few.append(np.full(len(long), steps[0] < FEW))
        self.item, self.offset, self.reach = np.concatenate(number), np.concatenate(offset), np.concatenate(reach)
        self.embedded = np.ascontiguousarray(np.concatenate(parts, axis=1).T)
        self.least = least_agreement(self.reach)
        few = np.concatenate(few)
        self.tables = []
        bits = min(24, max(12, int(32 * len(self.item)).bit_length()))
        self.shift = np.uint32(32 - bits)
        for sample, short in _TABLES:
            inside = np.flatnonzero((sample[-1] < self.reach) & (few | (not short)))
            if len(inside):
                k = _key(self.embedded[inside].T, sample)
                order = np.argsort(k, kind="stable")
                seen = np.zeros(1 << bits, dtype=bool)
                seen[k >> self.shift] = True
                self.tables.append((sample, k[order], inside[order], seen))
        self.steps = int(self.reach.max())

    def candidates(self, g: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item number, place of its first byte) of each candidate among windows from ``starts``."""
        items, firsts = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for at in range(0, len(starts), _CHUNK):
            own = starts[at : at + _CHUNK]
            e = walk(g, own, self.steps)
            pairs = []
            for sample, keys, order, seen in self.tables:
                k = _key(e, sample)
                w = np.flatnonzero(np.take(seen, (k >> self.shift).view(np.int32)))
                lo, hi = np.searchsorted(keys, k[w], "left"), np.searchsorted(keys, k[w], "right")
                count = hi - lo
                if count.any():
                    i = order[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
                    pairs.append(np.repeat(w, count) * len(self.item) + i)
            if pairs:
                rows = np.ascontiguousarray(e.T)
                pair = np.unique(np.concatenate(pairs))
                for k in range(0, len(pair), 20_000):
                    w, i = np.divmod(pair[k : k + 20_000], len(self.item))
                    near = (rows[w] == self.embedded[i, : self.steps]).sum(axis=1) >= self.least[i]
                    items.append(self.item[i[near]])
                    firsts.append(own[w[near]].astype(np.int64) - self.offset[i[near]])
        return np.concatenate(items), np.concatenate(firsts)


def infix_distance(item: str, text: str) -> int:
    """Least edit distance between item and any part of text (bit-parallel columns in one integer)."""
    if item in text:
        return 0
    n = len(item)
    full, high = (1 << n) - 1, 1 << (n - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best = full, 0, n, n
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        score += bool(ph & high) - bool(mh & high)
        best = min(best, score)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
    return best


def parts_of(item: str) -> list[str]:
    """An item in even parts of at most 64 characters."""
    n = -(-len(item) // 64)
    return [item[len(item) * k // n : len(item) * (k + 1) // n] for k in range(n)]


class _Parts:
    """Least edit distances between parts of items and pieces of text, many at a time.

    Characters are told apart by the first byte of their UTF-8 form only, so a distance is never above the true one. If an item
    is in a text with at most its share of edits, so is one of its parts.
    """

    def __init__(self, items: list[tuple[int, bytes]], most: list[int]):
        self.first, peq, size, limit = {}, [], [], []
        for (number, text), k in zip(items, most, strict=True):
            whole = text.decode("utf-8", "replace")
            parts = parts_of(whole)
            self.first[number] = (len(size), len(parts))
            for part in parts:
                row = np.zeros(256, dtype=np.uint64)
                for i, c in enumerate(part):
                    row[c.encode("utf-8", "surrogatepass")[0]] |= np.uint64(1 << i)
                peq.append(row)
                size.append(len(part))
                limit.append(k * len(part) // max(1, len(whole)))
        self.peq, self.size, self.limit = np.array(peq), np.array(size), np.array(limit)

    def possible(self, data: np.ndarray, items: list[int], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Which of the items may be in data[lo:hi]."""
        out = np.zeros(len(items), dtype=bool)
        for at in range(0, len(items), 2_000):
            own = slice(at, at + 2_000)
            wide = int((hi[own] - lo[own]).max())
            take = lo[own, None] + np.arange(wide)
            text = data[np.minimum(take, len(data) - 1)]
            text[take >= hi[own, None]] = 0
            text[(text & 0xC0) == 0x80] = 1  # not a character; left out below
            order = np.argsort(text == 1, axis=1, kind="stable")
            text = np.take_along_axis(text, order, axis=1)
            first, count = np.array([self.first[i] for i in items[own]]).T
            row = np.repeat(np.arange(len(first)), count)
            part = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            out[at + row[self._least(part, text[row]) <= self.limit[part]]] = True
        return out

    def _least(self, part: np.ndarray, text: np.ndarray) -> np.ndarray:
        one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
        last = (self.size[part] - 1).astype(np.uint64)
        pv, mv = np.full(len(part), full), np.zeros(len(part), dtype=np.uint64)
        score = self.size[part].copy()
        best = score.copy()
        for column in np.ascontiguousarray(text.T):
            eq = self.peq[part, column]
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            score += ((ph >> last) & one).astype(np.int64) - ((mh >> last) & one).astype(np.int64)
            np.minimum(best, score, out=best)
            ph, mh = ph << one, mh << one
            pv, mv = mh | ~(xv | ph), ph & xv
        return best


class Matcher:
    _kept: dict[str, Matcher] = {}

    def __init__(self, rows: list[tuple[int, str]], similarity: float):
        self.items, long, self.exact = [], [], ahocorasick.Automaton()
        for key, text in rows:
            data, _ = fold([(text or "").encode("utf-8", "surrogatepass")])
            folded = data[1:].tobytes().decode("utf-8", "replace").strip()
            number = len(self.items)
            self.items.append((key, folded, int((1 - similarity) * len(folded) + 1e-9)))
            if len(folded) >= SHORT:
                long.append((number, folded.encode()))
            elif folded:
                same = self.exact.get(f" {folded} ", [])
                self.exact.add_word(f" {folded} ", [*same, number])
        self.tables = _Tables(long) if long else None
        self.parts = _Parts(long, [self.items[i][2] for i, _ in long]) if long else None
        if len(self.exact):
            self.exact.make_automaton()

    @classmethod
    def of(cls, token: str, shared) -> Matcher:
        """The tables of a broadcast block of items, built once for each Python worker."""
        if token not in cls._kept:
            cls._kept.clear()
            cls._kept[token] = cls(*shared.value)
        return cls._kept[token]

    def block(self, texts: list[bytes], first_only: bool = False) -> list[list[tuple[int, int, float, int]]]:
        """The best match of each item in each text; with ``first_only``, one match of a text that has any."""
        found: list[list[tuple[int, int, float, int]]] = [[] for _ in texts]
        data, off = fold(texts)
        starts = word_starts(data)
        word = lambda d, at: max(0, int(np.searchsorted(starts, at, "right") - np.searchsorted(starts, off[d], "left")) - 1)
        if len(self.exact):
            for d in range(len(texts)):
                text = data[off[d] : off[d + 1] - 1].tobytes().decode("utf-8", "replace").strip()
                for i in sorted({i for _, numbers in self.exact.iter(f" {text} ") for i in numbers}):
                    at = off[d] + len(text[: f" {text} ".index(f" {self.items[i][1]} ")].encode())
                    found[d].append((self.items[i][0], 0, 1.0, word(d, at)))
        if self.tables is None or not len(starts):
            return found
        items, firsts = self.tables.candidates(grams(data), starts)
        if not len(items):
            return found
        # a window may begin with the words before the item's text; it is tried in the text that the item's middle falls in
        middle = firsts + np.array([len(self.items[i][1]) // 2 for i in items.tolist()])
        doc = np.searchsorted(off, np.clip(middle, 1, len(data) - 1), "right") - 1
        # of candidates within 16 bytes one is tried, with as much more text around it
        tries = np.unique(np.stack([doc, items, firsts // 16]), axis=1)
        slack = np.array([self.items[i][2] for i in tries[1].tolist()]) * 4 + 16
        size = np.array([len(self.items[i][1].encode()) for i in tries[1].tolist()])
        los, his = np.maximum(off[tries[0]], tries[2] * 16 - slack), np.minimum(off[tries[0] + 1] - 1, tries[2] * 16 + 16 + size + slack)
        some = np.flatnonzero(his > los)
        some = some[self.parts.possible(data, tries[1][some].tolist(), los[some], his[some])] if len(some) else some
        done: dict[tuple[int, int], tuple[int, int]] = {}
        for d, i, part, lo, hi in zip(*tries[:, some].tolist(), los[some].tolist(), his[some].tolist(), strict=True):
            if first_only and found[d]:
                continue
            key, text, most = self.items[i]
            known = done.get((d, i))
            if known is not None and known[0] == 0:
                continue
            distance = infix_distance(text, data[lo:hi].tobytes().decode("utf-8", "ignore"))
            if distance <= most and (known is None or distance < known[0]):
                done[d, i] = (distance, word(d, max(int(off[d]), part * 16)))
                if first_only:
                    found[d].append((key, distance, 1 - distance / len(text), done[d, i][1]))
        if not first_only:
            for (d, i), (distance, at) in done.items():
                key, text, _ = self.items[i]
                found[d].append((key, distance, 1 - distance / len(text), at))
        return found


_MATCHES = "array<struct<item_id:long,distance:int,similarity:double,near_word:int>>"


def matcher(spark: SparkSession, rows: list[tuple[int, str]], similarity: float, first_only: bool):
    """Column function: text -> matches with one block of items."""
    shared, token = spark.sparkContext.broadcast((rows, similarity)), uuid.uuid4().hex

    @F.pandas_udf(_MATCHES)
    def match(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher.of(token, shared)
        for p in parts:
            out, raw, size = [], [], 0
            for t in p:
                raw.append(t.encode("utf-8", "surrogatepass") if t else b"")
                size += len(raw[-1])
                if size >= BLOCK:
                    out += m.block(raw, first_only)
                    raw, size = [], 0
            out += m.block(raw, first_only)
            yield pd.Series([[dict(zip(("item_id", "distance", "similarity", "near_word"), x, strict=True)) for x in r] for r in out])

    return match


def item_blocks(items: DataFrame, key: str = "item_id", text: str = "text", size: int = ITEM_BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The items, at most ``size`` at a time on the driver."""
    block: list[tuple[int, str]] = []
    for row in items.select(F.col(key).cast("long"), text).where(F.col(text).isNotNull() & F.col(key).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _matches(docs: DataFrame, items: DataFrame, similarity: float, first_only: bool = False) -> Iterator[Column]:
    for rows in item_blocks(items):
        yield matcher(docs.sparkSession, rows, similarity, first_only)(F.coalesce(F.col("text"), F.lit("")))


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, distance, similarity, near_word: the best match of each document and item that match."""
    base, out = docs.select("doc_id", "text"), None
    for m in _matches(base, items, similarity):
        part = base.select("doc_id", F.explode(m).alias("m")).select("doc_id", "m.*")
        out = part if out is None else out.unionByName(part)
    return base.select("doc_id", F.explode(F.array().cast(_MATCHES)).alias("m")).select("doc_id", "m.*") if out is None else out


def decontaminate(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that match no item; all columns kept."""
    for m in _matches(docs, items, similarity, True):
        docs = docs.where(F.size(m) == 0)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
