"""BPE encoding and decoding by tree concatenation (op 10).

A text of at most ``leaf`` characters is encoded in one go. A longer one is halved again and again
down to leaves, which are rows of their own, so one very long text is encoded by many tasks. Two
neighbours are joined by encoding a window around their join anew; the window doubles on a
side until the new encoding repeats that side's own token at the window's edge (same id at the
same place), and only then replaces the tokens inside. A BPE encoding is right if and only if each pair of
neighbouring tokens is the encoding of its own text; at an edge that both sides agree on, the
pair is one that the side's own encoding already had, so agreement is exact, not a guess. Joins
run pairwise, as a tree.

White space always ends a pre-token here, so within a leaf the white-space-free chunks are looked up
in a bounded memo and only unseen pre-tokens reach the merge loop of the tokenizers library.

Defined results: null text is empty text; an empty text has no ids; special-token strings in a
text become their ids and split it, as the library does; every row gives one row, repeated rows
repeat; long texts that are equal are encoded once; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
#: Characters of a leaf. Longer texts are halved.
LEAF = 32_768
#: Tokens of a first window on each side of a join.
WINDOW = 8
#: Characters that a worker's memo holds before it starts over (about 12 bytes each with ids and decoded text, and
#: 300 a chunk), and the longest chunk that is remembered beyond the batch that has it.
MEMO, REMEMBERED = 4 << 20, 256

#: The characters with the White_Space property of Unicode.
_SPACE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_SPACES = regex.compile("[%s]" % _SPACE.replace(" ", ""))
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^%s\p{L}\p{N}]+" % _SPACE)
_END = "</w>"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def normalise(text: str) -> str:
    """NFC, white space as spaces, lower case letter by letter (no final sigma)."""
    text = _SPACES.sub(" ", unicodedata.normalize("NFC", text))
    return text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()


class Encoder:
    """Encoding of normalised text with a vocabulary file, kept for the life of a Python worker."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.strings = {i: t for t, i in spec["model"]["vocab"].items()} | {i: t for t, i in self.specials.items()}
        self.ends = np.zeros(max(self.strings) + 1, dtype=bool)
        self.ends[[i for i, t in self.strings.items() if t.endswith(_END)]] = True
        self.width = [len(self.strings.get(i, "").removesuffix(_END)) for i in range(len(self.ends))]  # a character for each byte
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        # pre-tokens come in one by one, so the model needs neither normaliser nor pattern in front
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ids_of: dict[str, bytes] = {}
        self.said_of: dict[str, str] = {}
        self.held, self.long = 0, set()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def pretokens(self, tokens: list[str]) -> dict[str, tuple[bytes, str]]:
        """(ids, decoded) of each pre-token: encoded side by side, cut after each word-end token."""
        ids = np.array(self.model.encode(" ".join(tokens), add_special_tokens=False).ids, dtype="<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        assert len(ends) == len(tokens)
        raw, said, at, out = ids.tobytes(), [self.strings[i] for i in ids.tolist()], 0, {}
        for token, end in zip(tokens, ends, strict=True):
            out[token] = (raw[4 * at : 4 * end], " ".join(said[at:end]))
            at = end
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encode white-space-free chunks and remember them; see MEMO."""
        for c in self.long - chunks:
            del self.ids_of[c], self.said_of[c]
        self.long &= chunks
        new = chunks.difference(self.ids_of)
        if not new:
            return
        size = lambda c: len(c) + 25
        if self.held + sum(map(size, new)) > MEMO:
            self.ids_of.clear()
            self.said_of.clear()
            self.held, self.long, new = 0, set(), chunks
        self.held += sum(size(c) for c in new if len(c) <= REMEMBERED)
        self.long |= {c for c in new if len(c) > REMEMBERED}
        cut = [(c, _PRETOKEN.findall(c)) for c in new if c]
        flat = list({t for _, tokens in cut for t in tokens})
        known = self.pretokens(flat) if flat else {}
        for chunk, tokens in cut:
            parts = [known[t] for t in tokens]
            self.ids_of[chunk] = b"".join([p[0] for p in parts])
            self.said_of[chunk] = " ".join([p[1] for p in parts])

    def whole(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Ids (little-endian unsigned 32-bit) and decoded text of whole texts that aren't normalised."""
        cut, every = [], set()
        for t in texts:
            parts = []
            for part in self.split.split(t) if t and "<|" in t else [t or ""]:
                chunks = [part] if part in self.specials else normalise(part).split(" ")
                parts.append((part in self.specials, chunks))
                if not parts[-1][0]:
                    every.update(chunks)
            cut.append(parts)
        every.discard("")
        self.learn(every)
        out = []
        for parts in cut:
            ids, said = [], []
            for special, chunks in parts:
                if special:
                    ids.append(np.array([self.specials[chunks[0]]], dtype="<u4").tobytes())
                    said.append(chunks[0])
                elif chunks := [c for c in chunks if c]:
                    ids.append(b"".join(map(self.ids_of.__getitem__, chunks)))
                    said.append(" ".join(map(self.said_of.__getitem__, chunks)))
            out.append((b"".join(ids), " ".join(said)))
        return out

    def ids(self, text: str) -> np.ndarray:
        """Ids of a normalised text."""
        chunks = [c for c in text.split(" ") if c]
        self.learn(set(chunks))
        return np.frombuffer(b"".join(map(self.ids_of.__getitem__, chunks)), dtype="<u4")

    def back(self, text: bytes, ids: np.ndarray) -> int:
        """Where the last tokens ``ids`` of an encoded text begin, in bytes."""
        at = len(text)
        for i in reversed(ids.tolist()):
            while text[at - 1] == 32:
                at -= 1
            at -= self.width[i]
        return at

    def forth(self, text: bytes, ids: np.ndarray) -> int:
        """Where the first tokens ``ids`` of an encoded text end, in bytes."""
        at = 0
        for i in ids.tolist():
            while text[at] == 32:
                at += 1
            at += self.width[i]
        return at

    def join(self, left: tuple[bytes, np.ndarray], right: tuple[bytes, np.ndarray]) -> tuple[bytes, np.ndarray]:
        """Concatenate two encoded neighbours (UTF-8 text, ids): see the module's text."""
        (lt, li), (rt, ri) = left, right
        a, b = WINDOW, WINDOW
        while True:
            whole_l, whole_r = a >= len(li), b >= len(ri)
            start = 0 if whole_l else self.back(lt, li[len(li) - a :])
            end = len(rt) if whole_r else self.forth(rt, ri[:b])
            try:
                w = self.ids((lt[start:] + rt[:end]).decode("utf-8"))
            except UnicodeDecodeError:  # an edge inside a character
                a, b = 2 * a, 2 * b
                continue
            ok_l = whole_l or len(w) > 0 and w[0] == li[len(li) - a]
            ok_r = whole_r or len(w) > 0 and w[-1] == ri[b - 1]
            if ok_l and ok_r:
                return lt + rt, np.concatenate([li[: 0 if whole_l else len(li) - a], w, ri[len(ri) if whole_r else b :]])
            a, b = a if ok_l else 2 * a, b if ok_r else 2 * b

    def tree(self, pieces: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
        while len(pieces) > 1:
            pieces = [self.join(pieces[i], pieces[i + 1]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
        return pieces[0][1] if pieces else np.empty(0, dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join([self.strings[i] for i in ids.tolist()])


def halves(text: str, leaf: int) -> list[str]:
    """Leaves of a text that is halved until each has at most ``leaf`` characters."""
    n = 1
    while -(-len(text) // n) > leaf:
        n *= 2
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(ids: bytes, said: str) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest()


def _short(path: str, tokens: bool):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder.of(path)
        for pdf in it:
            key = pdf.columns[0]
            for at in range(0, len(pdf), 128):
                part = pdf.iloc[at : at + 128]
                got = enc.whole(part["text"].tolist())
                rows = [_digests(a, s) for a, s in got]
                out = {key: part[key], "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]}
                yield pd.DataFrame(out | ({"ids": [np.frombuffer(a, dtype="<u4").astype(np.int32) for a, _ in got]} if tokens else {}))

    return run


def _cut(path: str, leaf: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder.of(path)
        for pdf in it:
            for key, text in zip(pdf["text_key"], pdf["text"], strict=True):
                rows = []
                for seg, part in enumerate(enc.split.split(text)):
                    if part in enc.specials:
                        rows.append((key, seg, 0, part, True))
                    else:
                        rows += [(key, seg, i, p, False) for i, p in enumerate(halves(normalise(part), leaf)) if p]
                yield pd.DataFrame(rows, columns=["text_key", "seg", "piece", "text", "special"])

    return run


def _leaves(path: str):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder.of(path)
        for pdf in it:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                got = [np.array([enc.specials[t]], dtype="<u4") if s else enc.ids(t) for t, s in zip(part["text"], part["special"], strict=True)]
                yield part.assign(ids=[a.tobytes() for a in got])

    return run


def _merge(path: str, tokens: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        enc = Encoder.of(path)
        pdf = pdf.sort_values(["seg", "piece"])
        parts = []
        for _, seg in pdf.groupby("seg", sort=True):
            parts.append(enc.tree([(t.encode("utf-8"), np.frombuffer(i, dtype="<u4")) for t, i in zip(seg["text"], seg["ids"], strict=True)]))
        ids = np.concatenate(parts).astype("<u4")
        n, a, b = _digests(ids.tobytes(), enc.decode(ids))
        out = {"text_key": [pdf["text_key"].iloc[0]], "n_tokens": [n], "ids_sha256": [a], "decoded_sha256": [b]}
        return pd.DataFrame(out | ({"ids": [ids.astype(np.int32)]} if tokens else {}))

    return run


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", leaf: int = LEAF, tokens: bool = False) -> DataFrame:
    """key, n_tokens, digests of ids and of the decoded text; with ``tokens`` also the ids as array<int>."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    extra = ", ids array<int>" if tokens else ""
    short = rows.where(F.length("text") <= leaf).mapInPandas(_short(path, tokens), f"{key} {kind}, {_RESULT}{extra}")
    long = rows.where(F.length("text") > leaf).withColumn("text_key", F.sha2("text", 256))
    pieces = long.select("text_key", "text").mapInPandas(_cut(path, leaf), "text_key string, seg int, piece int, text string, special boolean")
    pieces = pieces.dropDuplicates(["text_key", "seg", "piece"])
    leaves = pieces.mapInPandas(_leaves(path), "text_key string, seg int, piece int, text string, special boolean, ids binary")
    merged = leaves.groupBy("text_key").applyInPandas(_merge(path, tokens), f"text_key string, {_RESULT}{extra}")
    return short.unionByName(long.select(key, "text_key").join(merged, "text_key", "left").drop("text_key").na.fill({"n_tokens": 0}))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with ``decoded``: the text of the ids, special tokens kept."""

    @F.pandas_udf("string")
    def said(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = Encoder.of(path)
        for p in parts:
            yield pd.Series([None if a is None else enc.decode(np.asarray(a)) for a in p])

    return encoded.withColumn("decoded", said(ids))


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
