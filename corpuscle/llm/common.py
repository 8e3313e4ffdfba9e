"""Shared helpers: tables written in the cluster's shared folder, vectorised word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.storage import cut_lineage as materialise
from corpuscle.operators.storage import shared_folder as shared_dir

__all__ = ["KeyFilter", "TextBlock", "blocks", "key_filter", "materialise", "mix", "ngrams", "powers", "prefix_hash", "shared_dir", "words"]

#: Bytes hashed at a time inside a task; bounds the numpy temporaries of one step.
BLOCK_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C55  # odd multiplier of the polynomial hash
_PINV = pow(_P, -1, 1 << 64)
_POWERS: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**0..p**n and the inverse powers, modulo 2**64; grown by doubling and kept."""
    if _POWERS.get("size", 0) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        for name, base in (("up", _P), ("down", _PINV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
        _POWERS["size"] = size
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 on a uint64 array (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_DELIM = np.zeros(256, dtype=bool)
_DELIM[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of (data[j] + 1) * p**j for j < i, modulo 2**64."""
    pw, _ = powers(len(data))
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=out[1:])
    return out


def _block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = np.ones(len(data) + 2, dtype=bool)
    d[1:-1] = _DELIM[data]
    starts = np.flatnonzero(d[:-2] & ~d[1:-1])
    ends = np.flatnonzero(~d[1:-1] & d[2:]) + 1
    h = prefix_hash(data)
    _, inv = powers(len(data))
    return mix((h[ends] - h[starts]) * inv[starts]), starts, ends


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes and byte spans of the words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes.

    Works block by block (cut at a delimiter), so a very long text needs no more than a few
    blocks of temporaries beside its result.
    """
    data = np.frombuffer(raw, dtype=np.uint8)
    if len(data) <= BLOCK_BYTES:
        return _block_words(data)
    parts, at = [], 0
    while at < len(data):
        end = min(at + BLOCK_BYTES, len(data))
        if end < len(data):
            cut = np.flatnonzero(_DELIM[data[at:end]])
            while not len(cut) and end < len(data):
                end = min(end + BLOCK_BYTES, len(data))
                cut = np.flatnonzero(_DELIM[data[at:end]])
            if len(cut) and end < len(data):
                end = at + int(cut[-1]) + 1
        h, s, e = _block_words(data[at:end])
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


class TextBlock:
    """The words of a run of texts: ``h`` hashes, ``s``/``e`` byte spans in ``raw``, ``off`` word offset by text."""

    def __init__(self, texts: list[bytes], lower: bool):
        raw = b" ".join(texts)
        if lower:
            raw = raw.translate(_LOWER)
        self.raw = raw
        self.h, self.s, self.e = words(raw)
        self.base = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.base[1:])
        self.off = np.searchsorted(self.s, self.base)


def blocks(texts: list[str | None], lower: bool = False) -> Iterator[tuple[int, int, TextBlock]]:
    """Cut a batch of texts (null: empty) into blocks of about BLOCK_BYTES; yields (first, end, block)."""
    raw, size, first = [], 0, 0
    for i, t in enumerate(texts):
        raw.append(t.encode("utf-8", "surrogatepass") if t else b"")
        size += len(raw[-1])
        if size >= BLOCK_BYTES:
            yield first, i + 1, TextBlock(raw, lower)
            raw, size, first = [], 0, i + 1
    if raw:
        yield first, len(texts), TextBlock(raw, lower)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent 64-bit hash of each run of n word hashes (length len(h) - n + 1, or 0)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(_P)
        out += h[k : k + m]
    return mix(out)


class KeyFilter:
    """A broadcast bitmap over keys: ``hit`` tells which keys may be in the set; a miss is certain."""

    #: Bits of a filter: 16 to 32 for each key, 8 KB at least and 64 MB at most.
    LEAST_BITS, MOST_BITS = 16, 29
    #: Bits that one group sets.
    PART_BITS = 16
    #: Bits that a key sets, so a key outside the set passes with a chance of 0.005 at most while the filter isn't full.
    PROBES = 3

    def __init__(self, bits: int, shared, full: bool, probes: int):
        #: full: there were more keys than the largest filter has room for.
        self.bits, self.shared, self.full, self.probes = bits, shared, full, probes

    def hit(self, key: np.ndarray) -> np.ndarray:
        low, high = key & ((1 << self.bits) - 1), (key >> 32) & ((1 << self.bits) - 1)
        out = np.ones(len(key), dtype=bool)
        for k in range(self.probes):
            at = (low + k * (high | 1)) & ((1 << self.bits) - 1)
            out &= (self.shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out

    def release(self) -> None:
        """Free the executors' copies; they are sent again should a lost task need them."""
        self.shared.unpersist()


def key_filter(keys: DataFrame, probes: int = KeyFilter.PROBES, at_once: bool = False) -> KeyFilter:
    """Filter over the one long column of ``keys``, a written table (it is read twice: counted and set).

    at_once: fetch the parts, 64 MB at most, in one job instead of one for each partition.

    The bits are set on the executors, part by part, so the driver gets a few binary rows of 64 MB in all at most.
    Beyond 2**29 / 16 keys the filter is ``full`` and lets more through; all its users check exactly behind it.
    """
    spark, column = keys.sparkSession, keys.columns[0]
    need = int(16 * keys.count()).bit_length()
    bits = min(KeyFilter.MOST_BITS, max(KeyFilter.LEAST_BITS, need))
    part, mask = KeyFilter.PART_BITS, F.lit((1 << bits) - 1)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << part, dtype=bool)
        own[pdf["at"].to_numpy() & ((1 << part) - 1)] = True
        return pd.DataFrame({"p": pdf["p"].iloc[:1], "raw": [np.packbits(own, bitorder="little").tobytes()]})

    low, high = F.col(column).bitwiseAND(mask), F.shiftright(column, 32).bitwiseAND(mask).bitwiseOR(F.lit(1))
    places = F.array(*((low + k * high).bitwiseAND(mask) for k in range(probes)))
    at = keys.select(F.explode(places).alias("at")).distinct().withColumn("p", F.shiftright("at", part))
    whole = np.zeros(1 << (bits - 3), dtype=np.uint8)
    parts = at.groupBy("p").applyInPandas(fill, "p long, raw binary")
    for p, raw in parts.collect() if at_once else parts.toLocalIterator():
        whole[p << (part - 3) : (p + 1) << (part - 3)] = np.frombuffer(raw, dtype=np.uint8)
    return KeyFilter(bits, spark.sparkContext.broadcast(whole), need > bits, probes)
