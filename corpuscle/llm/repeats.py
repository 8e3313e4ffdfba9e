"""Repeated windows of a corpus: the Spark side of suffix-array dedup (op 4) and substring dedup (op 8).

Both ask which windows of fixed length (400 bytes, 20 words) occur more than once. A window is routed by
its *anchor*, the gram of least hash inside it (leftmost on ties), which depends on the window's content only,
so equal windows meet. Consecutive windows with one anchor form a *segment*. Then:

1. places of segments are written as keys, hashes and positions, without their content;
2. equal segments of one anchor are grouped (count and first place, with map-side combine), so copies
   cost one segment however many they are;
3. the first place of each distinct segment of an anchor that occurs more than once is cut from its text, in a
   further pass that bitmaps over the picked places steer, so no text is shuffled;
4. the distinct segments are dealt by anchor; each task solves runs of anchors of about SHARD_BYTES with
   the index of the operator (a bucket-refined suffix array, an FM-index);
5. an anchor with more than HOT_BYTES of distinct segments (the edge of a passage with many contexts) isn't left to one
   task. A window of it can only repeat if the 128-bit hash of the window does, so windows are counted by hash, as keys;
   of each repeated hash the first and the last window are cut out as segments of one window, dealt by
   the hash, and solved by the same index in shards of the same size. What it confirms goes back to all windows of that hash;
6. results go back to all places of their segment, by a join that Spark can split at hot keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.common import BLOCK_BYTES, KeyFilter, TextBlock, key_filter, materialise, mix, ngrams, powers, prefix_hash

SHARD_BYTES = 1 << 20
#: Most bytes of content that one anchor brings to a task, counted as distinct segments of a usual length (see ``hot`` of the
#: units); above it, its repeated windows are dealt one by one.
HOT_BYTES = 4 << 20


class _ByteTexts:
    """A block of texts as bytes, laid end to end."""

    def __init__(self, unit: Bytes, texts: list[bytes]):
        self.unit, self.texts = unit, texts
        self.off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def segments(self) -> tuple[np.ndarray, ...]:
        data, gram = np.frombuffer(b"".join(self.texts), dtype=np.uint8), self.unit.gram

        def grams(a: int, b: int) -> np.ndarray:
            h = prefix_hash(data[a:b])
            m = b - a - gram + 1
            return mix((h[gram:] - h[:m]) * powers(b - a)[1][:m])

        return _segments(self.unit, len(data), grams, self.off)

    def cut(self, i: int, a: int, b: int) -> bytes:
        """Content of the units from a to b of a text."""
        return self.texts[i][a:b]


class _WordTexts:
    """A block of texts as words."""

    def __init__(self, unit: Words, texts: list[bytes]):
        self.unit, self.block = unit, TextBlock(texts, False)
        self.off = self.block.off

    def segments(self) -> tuple[np.ndarray, ...]:
        return _segments(self.unit, len(self.block.h), lambda a, b: ngrams(self.block.h[a:b], self.unit.gram), self.off)

    def cut(self, i: int, a: int, b: int) -> bytes:
        """Content of the words from a to b of a text, with the white space between them."""
        b_ = self.block
        return b_.raw[b_.s[self.off[i] + a] : b_.e[self.off[i] + b - 1]]


@dataclass(frozen=True)
class Bytes:
    """Windows of ``window`` bytes, anchored by grams of ``gram`` bytes."""

    window: int
    gram: int
    #: Units that are segmented at a time, however long a text is.
    stretch: int = 1 << 20
    #: Segments are few for each byte of text: their places are written in one pass.
    prefilter: ClassVar[bool] = False
    open: ClassVar = _ByteTexts

    @property
    def hot(self) -> int:
        """Most distinct segments of an anchor that one task solves, each of about two and a half windows."""
        return max(1, HOT_BYTES * 2 // (self.window * 5))

    def window_hashes(self, content: bytes, salt: int) -> np.ndarray:
        data = np.frombuffer(content, dtype=np.uint8) ^ np.uint8(salt)
        h = prefix_hash(data)
        n = len(data) - self.window + 1
        return mix((h[self.window :] - h[:n]) * powers(len(data))[1][:n])


@dataclass(frozen=True)
class Words:
    """Windows of ``window`` words, anchored by grams of ``gram`` words. A segment's content is its words with the white space between them."""

    window: int
    gram: int
    #: Units that are segmented at a time, however long a text is.
    stretch: int = 1 << 20
    #: Segments are many: a first pass finds the repeated anchors, so that only their places are written.
    prefilter: ClassVar[bool] = True
    open: ClassVar = _WordTexts

    @property
    def hot(self) -> int:
        """Most distinct segments of an anchor that one task solves, each of about one and a half windows of six-byte words."""
        return max(1, HOT_BYTES // (self.window * 8))

    def window_hashes(self, content: bytes, salt: int) -> np.ndarray:
        return ngrams(mix(TextBlock([content], False).h ^ np.uint64(salt)), self.window)


def _segments(unit, n: int, grams: Callable[[int, int], np.ndarray], off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor key, text number, first window, number of windows, content hash) of the segments of texts of n units, laid end to end.

    grams(a, b): hash of each gram of the units from a to b. Windows are taken about ``stretch`` at a time. A text longer than that
    is cut at multiples of ``stretch`` from its own start, and its segments too, so they don't depend on its neighbours. The content hash is a polynomial over the mixed gram hashes and not over the units, so texts of a regular
    structure don't collide by it.
    """
    out = [tuple(np.empty(0, dtype=np.int64) for _ in range(5))]
    cuts = [0]
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - cuts[-1] > unit.stretch and a > cuts[-1]:
            cuts.append(a)
        cuts += range(a + unit.stretch, b, unit.stretch)
    for at, next_ in zip(cuts, [*cuts[1:], n], strict=True):
        end = min(n, next_ + unit.window - 1)
        if end - at >= unit.window:
            out.append(_stretch(grams(at, end), at, off, unit.window, unit.gram))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _stretch(g: np.ndarray, at: int, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    width = window - gram + 1
    bits = int(len(g)).bit_length()
    low = np.uint64((1 << bits) - 1)
    v = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    size, done = len(v) - width + 1, 1
    while done < width:
        step = min(done, width - done)
        v = np.minimum(v[: len(v) - step], v[step:])
        done += step
    starts = np.arange(at, at + size)
    text = np.repeat(np.arange(len(off) - 1), np.diff(np.clip(off, at, at + size)))
    ok = starts + window <= off[text + 1]
    starts, text, anchor = starts[ok], text[ok], (v[ok] & low).astype(np.int64)
    if not len(starts):
        return tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    up, down = powers(len(g))
    h = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(g * up[: len(g)], dtype=np.uint64)])
    a, b = starts[first] - at, starts[first] - at + count + window - gram
    content = mix(mix((h[b] - h[a]) * down[a]) ^ (b - a).astype(np.uint64))
    return g[anchor[first]].view(np.int64), text[first], starts[first] - off[text[first]], count, content.view(np.int64)


def _text_blocks(texts: pd.Series) -> Iterator[tuple[int, list[bytes]]]:
    raw, size, first = [], 0, 0
    for i, t in enumerate(texts):
        raw.append(t.encode("utf-8", "surrogatepass") if t else b"")
        size += len(raw[-1])
        if size >= BLOCK_BYTES:
            yield first, raw
            raw, size, first = [], 0, i + 1
    if raw:
        yield first, raw


def row_key() -> Column:
    """With doc_id, the key of a row: rows are told apart by (doc_id, hash), so only texts of one doc_id could be mistaken."""
    return F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("text"))


def _keys(unit):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for _, raw in _text_blocks(pdf["text"]):
                yield pd.DataFrame({"a_key": unit.open(unit, raw).segments()[0]})

    return run


_PLACES = "a_key long, seg_key long, rk long, doc long, start int, n int"
_PICK = ("a_key", "seg_key", "rk", "doc", "start")


def _positions(unit, anchors: KeyFilter | None):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rk, doc = pdf["rk"].to_numpy(), pdf["doc"].to_numpy()
            for first, raw in _text_blocks(pdf["text"]):
                key, text, start, count, seg = unit.open(unit, raw).segments()
                hit = anchors.hit(key) if anchors is not None else np.ones(len(key), dtype=bool)
                at = first + text[hit]
                yield pd.DataFrame({"a_key": key[hit], "seg_key": seg[hit], "rk": rk[at], "doc": doc[at], "start": start[hit].astype(np.int32), "n": count[hit].astype(np.int32)})

    return run


def _contents(unit, texts: KeyFilter, places: KeyFilter):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf = pdf[texts.hit(pdf["rk"].to_numpy())]
            rks, docs = pdf["rk"].to_numpy(), pdf["doc"].to_numpy()
            for first, raw in _text_blocks(pdf["text"]):
                block = unit.open(unit, raw)
                key, text, start, count, seg = block.segments()
                rk, doc = rks[first + text], docs[first + text]
                hit = np.flatnonzero(places.hit(rk ^ start))
                for at in range(0, len(hit), 2048):
                    h = hit[at : at + 2048]
                    content = [block.cut(i, a, b) for i, a, b in zip(text[h].tolist(), start[h].tolist(), (start[h] + count[h] + unit.window - 1).tolist(), strict=True)]
                    yield pd.DataFrame({"a_key": key[h], "seg_key": seg[h], "doc": doc[h], "start": start[h].astype(np.int32), "n": count[h].astype(np.int32), "content": content})

    return run


def contents(docs: DataFrame, unit, picks: DataFrame, exact: bool = False) -> DataFrame:
    """a_key, seg_key, doc, start, n, content of the places in ``picks`` (the columns of _PICK; a written table).

    The few other places that the bitmaps let through by chance are later places of a known content, or lone
    ones, and change nothing. Where more than a few could pass (a full bitmap), or with ``exact``, they are dropped by a join
    on the whole place, whose keys no copies make hot.
    """
    place = F.col("rk").bitwiseXOR(F.col("start").cast("long"))
    texts, places = key_filter(picks.select("rk")), key_filter(picks.select(place.alias("p")))
    cut = docs.select("rk", "doc", "text").mapInPandas(_contents(unit, texts, places), "a_key long, seg_key long, doc long, start int, n int, content binary")
    if exact or texts.full or places.full:
        place = ["a_key", "seg_key", "doc", "start"]
        cut = cut.join(picks.select(*place), place, "left_semi")
    return cut


def occurrences(docs: DataFrame, unit) -> DataFrame:
    """Places of segments, at least of those whose anchor occurs more than once. Written out. docs: rk, doc, text."""
    source = docs.select("rk", "doc", "text")
    if not unit.prefilter:
        return materialise(source.mapInPandas(_positions(unit, None), _PLACES))
    anchors = docs.select("text").mapInPandas(_keys(unit), "a_key long").groupBy("a_key").count().where("count > 1").select("a_key")
    repeated = key_filter(materialise(anchors))
    found = materialise(source.mapInPandas(_positions(unit, repeated), _PLACES))
    repeated.release()
    return found


def distinct_segments(found: DataFrame) -> DataFrame:
    """One row for each content of an anchor that occurs more than once: its count c and its first place (doc, start, rk). Written out."""
    segs = found.groupBy("a_key", "seg_key").agg(F.count("*").alias("c"), F.min(F.struct("doc", "start", "rk")).alias("first"))
    segs = materialise(segs.select("a_key", "seg_key", "c", "first.doc", "first.start", "first.rk"))
    many = segs.groupBy("a_key").agg(F.sum("c").alias("total"), F.count("*").alias("d")).where("total > 1").select("a_key", "d")
    return materialise(segs.join(many, "a_key"))


def _first_places(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first row of each (a_key, seg_key); the input is sorted by them, doc and start. Later places, however many, aren't held."""
    last = None
    for pdf in it:
        keys = pdf[["a_key", "seg_key"]].to_numpy()
        if len(keys):
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            new[0] = last is None or bool((keys[0] != last).any())
            last = keys[-1]
            yield pdf[new]


def _runs(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole anchors, gathered to about SHARD_BYTES of content; the input is sorted by anchor."""
    held, size = [], 0
    for pdf in it:
        keys = pdf["a_key"].to_numpy()
        total = np.cumsum(pdf["content"].map(len).to_numpy())
        at = 0
        while at < len(pdf):
            before = total[at - 1] if at else 0
            end = int(np.searchsorted(total - before, max(1, SHARD_BYTES - size), "left")) + 1
            if end >= len(pdf):
                held.append(pdf.iloc[at:])
                size += int(total[-1] - before)
                break
            while end > at and keys[end] == keys[end - 1]:  # back to where this anchor begins
                end -= 1
            if end > at and keys[end - 1] != keys[end] and (end > at):
                held.append(pdf.iloc[at:end])
                yield pd.concat(held, ignore_index=True)
                held, size, at = [], 0, end
            elif held and held[-1]["a_key"].iloc[-1] != keys[at]:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
            else:  # one anchor goes on over the limit
                end = int(np.searchsorted(keys[at:], keys[at], "right")) + at
                held.append(pdf.iloc[at:end])
                size += int(total[end - 1] - before)
                at = end
    if held:
        yield pd.concat(held, ignore_index=True)


def intervals(flags: np.ndarray) -> list[dict]:
    """Runs of true as (lo, hi), hi exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_SOLVED = "a_key long, seg_key long, hits array<struct<lo:int,hi:int>>"


def _solve(unit, solver):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard in _runs(_first_places(it)):
            flags = solver(unit, shard)
            some = np.array([f.any() for f in flags], dtype=bool)
            hits = pd.Series([intervals(f) for f in flags if f.any()], dtype=object)
            yield pd.DataFrame({"a_key": shard["a_key"].to_numpy()[some], "seg_key": shard["seg_key"].to_numpy()[some], "hits": hits})

    return run


def indexed(segments: DataFrame, unit, solver) -> DataFrame:
    """a_key, seg_key and the flagged windows of the segments that have any, by the operator's index over shards of whole anchors."""
    return segments.repartition("a_key").sortWithinPartitions("a_key", "seg_key", "doc", "start").mapInPandas(_solve(unit, solver), _SOLVED)


def _window_rows(unit):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                h1 = [unit.window_hashes(c, 0) for c in part["content"]]
                h2 = [unit.window_hashes(c, 0x5A) for c in part["content"]]
                n = [len(h) for h in h1]
                yield pd.DataFrame(
                    {
                        "w1": np.concatenate(h1).view(np.int64),
                        "w2": np.concatenate(h2).view(np.int64),
                        "a_key": np.repeat(part["a_key"].to_numpy(), n),
                        "seg_key": np.repeat(part["seg_key"].to_numpy(), n),
                        "i": np.concatenate([np.arange(k) for k in n]).astype(np.int32),
                        "doc": np.repeat(part["doc"].to_numpy(), n),
                        "at": np.concatenate([np.arange(k) + s for k, s in zip(n, part["start"], strict=True)]),
                    }
                )

    return run


def _single_windows(unit):
    """Segments of one window each, cut from the content of the segment they lie in."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            cut = [unit.open(unit, [c]).cut(0, i, i + unit.window) for c, i in zip(pdf["content"], pdf["i"].tolist(), strict=True)]
            yield pd.DataFrame({"a_key": pdf["w1"], "seg_key": pdf["piece"], "doc": pdf["doc"], "start": pdf["at"].astype(np.int32), "n": np.ones(len(pdf), dtype=np.int32), "content": cut})

    return run


def _hot_windows(docs: DataFrame, unit, solver, hot: DataFrame, earlier: bool) -> DataFrame:
    """As ``indexed``, for anchors with more content than one task takes. hot: the columns of _PICK; written out."""
    own = materialise(contents(docs, unit, hot, exact=True).dropDuplicates(["a_key", "seg_key"]))
    rows = materialise(own.mapInPandas(_window_rows(unit), "w1 long, w2 long, a_key long, seg_key long, i int, doc long, at long"))
    place = F.struct("doc", "at", "a_key", "seg_key", "i")
    shared = materialise(rows.groupBy("w1", "w2").agg(F.count("*").alias("m"), F.min(place).alias("first"), F.max(place).alias("last")).where("m > 1"))
    both = F.explode(F.array(F.struct(F.col("first").alias("p"), F.col("w2").alias("piece")), F.struct(F.col("last").alias("p"), F.bitwise_not("w2").alias("piece"))))
    picked = shared.select("w1", both.alias("e")).select("w1", "e.piece", "e.p.*")
    pieces = picked.join(own.select("a_key", "seg_key", "content"), ["a_key", "seg_key"]).select("w1", "piece", "doc", "at", "i", "content")
    solved = indexed(pieces.mapInPandas(_single_windows(unit), "a_key long, seg_key long, doc long, start int, n int, content binary"), unit, solver)
    sure = shared.join(solved.select(F.col("a_key").alias("w1"), F.bitwise_not("seg_key").alias("w2")), ["w1", "w2"], "left_semi").select("w1", "w2", "first")
    flagged = rows.join(sure, ["w1", "w2"])
    if earlier:
        flagged = flagged.where(F.struct("doc", "at") != F.struct("first.doc", "first.at"))
    hits = F.transform(F.collect_list("i"), lambda i: F.struct(i.alias("lo"), (i + 1).alias("hi")))
    return flagged.groupBy("a_key", "seg_key").agg(hits.alias("hits"))


def solve(docs: DataFrame, unit, solver, earlier: bool) -> DataFrame:
    """rk, doc, removed windows (lo, hi: window starts, hi exclusive) of every occurrence.

    earlier: a window goes if it also starts earlier; else if it also starts anywhere else.
    """
    found = occurrences(docs, unit)
    segs = distinct_segments(found)
    hot = materialise(segs.where(F.col("d") > unit.hot).select(*_PICK))
    if hot.isEmpty():
        solved = indexed(contents(docs, unit, segs), unit, solver)
    else:
        cold = materialise(segs.where(F.col("d") <= unit.hot).select(*_PICK))
        rest = contents(docs, unit, cold).join(hot.select("a_key").distinct(), "a_key", "left_anti")
        solved = indexed(rest, unit, solver).unionByName(_hot_windows(docs, unit, solver, hot, earlier))
    first = segs.select("a_key", "seg_key", "c", F.col("doc").alias("f_doc"), F.col("start").alias("f_start"))
    # written out, so that Spark can split the join below at segments of many copies
    first = materialise(first.join(solved, ["a_key", "seg_key"], "left").where("c > 1 or hits is not null"))
    occ = found.join(first, ["a_key", "seg_key"])
    # a copy of a segment goes as a whole; the segment itself by what the index says of its content
    whole = (F.col("doc") != F.col("f_doc")) | (F.col("start") != F.col("f_start")) if earlier else F.col("c") > 1
    hits = F.when(whole, F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi")))).otherwise(F.col("hits"))
    occ = occ.select("rk", "doc", F.transform(hits, lambda h: F.struct((h["lo"] + F.col("start")).alias("lo"), (h["hi"] + F.col("start")).alias("hi"))).alias("runs"))
    return occ.where(F.size("runs") > 0)


def removed_by_row(docs: DataFrame, unit, solver, earlier: bool, finish, schema: str) -> DataFrame:
    """doc_id and the columns of ``schema`` for each row of docs (rk, doc, doc_id, text); finish(text bytes, runs) gives their values.

    Rows without a removed window are finished in the first pass; only texts with one (by a bitmap) are shuffled.
    Runs are gathered as a set, so a row that is repeated many times brings its runs once.
    """
    runs = solve(docs.select("rk", "doc", "text"), unit, solver, earlier).groupBy("rk", "doc").agg(F.flatten(F.collect_set("runs")).alias("runs"))
    runs = materialise(runs)
    touched = key_filter(runs.select("rk"))
    names = [c.split()[0] for c in schema.split(", ")]

    def first(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            hit = touched.hit(pdf["rk"].to_numpy())
            done = [(None,) * len(names) if h else finish(t.encode("utf-8", "surrogatepass"), None) for h, t in zip(hit, pdf["text"], strict=True)]
            out = pd.DataFrame(done, columns=names).convert_dtypes() if len(done) else pd.DataFrame(columns=names)
            out.insert(0, "text", pdf["text"].where(hit, None).to_numpy())
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            out.insert(0, "doc", pdf["doc"].to_numpy())
            out.insert(0, "rk", pdf["rk"].to_numpy())
            yield out

    def second(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rest = pdf["text"].notna().to_numpy()
            done = [finish(t.encode("utf-8", "surrogatepass"), r) if h else v for h, t, r, v in zip(rest, pdf["text"], pdf["runs"], pdf[names].itertuples(index=False, name=None), strict=True)]
            out = pd.DataFrame(done, columns=names)
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out

    early = docs.select("rk", "doc", "doc_id", "text").mapInPandas(first, f"rk long, doc long, doc_id long, text string, {schema}")
    return early.join(runs, ["rk", "doc"], "left").drop("rk", "doc").mapInPandas(second, f"doc_id long, {schema}")


def covered(runs, window: int, size: int) -> np.ndarray:
    """Mask of the units that removed windows cover."""
    edge = np.zeros(size + 1, dtype=np.int64)
    for r in runs if runs is not None else ():
        edge[r["lo"]] += 1
        edge[r["hi"] - 1 + window] -= 1
    return np.cumsum(edge[:-1]) > 0
