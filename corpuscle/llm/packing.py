"""Packing of documents into token sequences by power-of-two decomposition (op 12).

A document of n ids is cut into n div limit pieces of ``limit`` ids and then one piece for each set bit of the rest, longest
first. Every piece is a sequence of its own: none crosses documents, none is padded, and sequences of one length form a bucket
from which training draws batches. Sequences are numbered bucket by bucket, longest first, without gaps.

Texts are encoded and cut where they are read. A task counts the pieces of each length as it goes, so a piece's number is its
number within its task plus the pieces of that length in the tasks before: a sum over one row for each task and length. No
document is shuffled. The numbers are settled once the pieces are written, so a lost executor changes nothing after that.

Defined results: null text is empty text, and an empty text has only the closing id; a special-token string in a text becomes
its id, as the tokenizers library does; each row is packed, repeated rows and rows without id alike; a text of any length is
encoded in stretches cut where white space begins, which no pre-token crosses; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from corpuscle.llm.common import materialise

VOCABULARY = "byte_bpe_50k.json"
LIMIT, END = 2048, 1
#: Characters that are encoded at a time.
STRETCH = 1 << 16
#: Rows encoded before they are handed on.
ROWS = 256

_CUT = re.compile(r"(?<=\S)[ \n]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def stretches(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` characters that are encoded alike alone and together: each later one begins with white space."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class ByteEncoder:
    """Byte-level BPE from a vocabulary file of the tokenizers library; kept for the life of a Python worker.

    The merge loop is tiktoken's, with the ids of the file as ranks, as merges of such a file are listed by id. Where its pattern
    engine gives up (long runs of white space), the tokenizers library encodes the stretch.
    """

    _kept: dict[str, ByteEncoder] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.plain = Tokenizer.from_file(path)
        self.plain.no_truncation()
        self.plain.no_padding()

    @classmethod
    def of(cls, path: str) -> ByteEncoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def ids(self, text: str | None) -> np.ndarray:
        out = []
        for part in stretches(text or "", STRETCH):
            try:
                got = self.fast.encode(part, allowed_special="all")
            except ValueError:
                got = self.plain.encode(part, add_special_tokens=False).ids
            out.append(np.array(got, dtype="<u4"))
        return out[0] if len(out) == 1 else np.concatenate(out)


def binary_lengths(n: int, limit: int) -> list[int]:
    """Lengths of the pieces of n ids: whole limits, then the set bits of the rest, longest first."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << k for k in range(limit.bit_length() - 2, -1, -1) if rest >> k & 1]


def _pieces(path: str, limit: int, end: int, ids: bool, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, made = ByteEncoder.of(path), {1 << k: 0 for k in range(limit.bit_length())}
        close = np.array([end], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                owner, rows = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    tokens, start = np.concatenate([enc.ids(text), close]).tobytes(), 0
                    n = len(tokens) // 4
                    for length in binary_lengths(n, limit):
                        raw = tokens[4 * start : 4 * (start + length)]
                        owner.append(i)
                        rows.append((start, length, zlib.crc32(raw), n, made[length]) + ((raw,) if ids else ()))
                        made[length] += 1
                        start += length
                arrays = [part.column(0).take(pa.array(owner, pa.int64()))]
                arrays += [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def pack(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (always 0), with ``ids`` also the ids.

    ids is binary: little-endian unsigned 32-bit numbers. ``limit`` is a power of two.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError(f"limit must be a power of two, not {limit}")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    columns = ["start", "length", "ids_crc32", "doc_tokens", "number"]
    fields = [pa.field(c, pa.int64()) for c in columns] + ([pa.field("ids", pa.binary())] if ids else [])
    schema = pa.schema([pa.field("key", to_arrow_type(docs.schema[key].dataType)), *fields])
    ddl = f"key {kind}, " + ", ".join(f"{c} bigint" for c in columns) + (", ids binary" if ids else "")
    pieces = materialise(rows.mapInArrow(_pieces(path, limit, end, ids, schema), ddl).withColumn("task", F.spark_partition_id()))
    made = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    total = made.groupBy("length").agg(F.sum("n").alias("n"))  # one row per power of two up to the limit
    first = total.select("length", (F.sum("n").over(Window.orderBy(F.desc("length"))) - F.col("n")).alias("first"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    made = made.join(F.broadcast(first), "length").select("length", "task", (before + F.col("first")).alias("before"))
    out = [F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("number")).alias("sequence_id")]
    return pieces.join(made, ["length", "task"]).select(*out, F.lit(0).cast("long").alias("offset"), *(["ids"] if ids else []))


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """Packed pieces as Parquet, a folder for each length."""
    pieces.write.partitionBy("length").parquet(folder)


def op12_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path(), ids=False)
