"""Permutation-filled lookup table (op 5): shards take turns claiming slots of a prime-sized table.

Each shard has its own preference order of the slots, ``(offset + j * skip) mod size``; as the size is
prime that is a permutation. In turns, each shard claims the first slot of its order that is still
free, until the table is full; so shares differ by at most one slot, and adding or removing a shard
moves few slots. The table has ``size`` rows, a parameter that does not grow with the data, so it is
broadcast and placing a row is one hash and one lookup, with no shuffle.

Defined results: a null key is placed like the empty string; equal keys (ties, repeated rows) get
equal shards; an empty table gives an empty result with the same columns; other columns of the input
are kept by ``place`` and never read, names clashing with ``slot`` and ``shard`` are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, SHARDS = 2039, 16


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: int = SHARDS, size: int = SIZE) -> list[int]:
    """Owner of each slot. A control-plane loop of ``size`` steps, independent of the data."""
    if shards < 1 or shards > size or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime of at least the number of shards")
    offset = [_number(f"offset:{i}") % size for i in range(shards)]
    skip = [_number(f"skip:{i}") % (size - 1) + 1 for i in range(shards)]
    owner, step = [-1] * size, [0] * shards
    for turn in range(size):
        i = turn % shards
        while owner[slot := (offset[i] + step[i] * skip[i]) % size] >= 0:
            step[i] += 1
        owner[slot] = i
    return owner


def table(spark: SparkSession, shards: int = SHARDS, size: int = SIZE) -> DataFrame:
    """slot int, shard int: the lookup table as rows."""
    owners = ",".join(map(str, fill_table(shards, size)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "s")).select("slot", F.col("s").cast("int").alias("shard"))


def slot_of(key: Column, size: int = SIZE) -> Column:
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: int = SHARDS, size: int = SIZE) -> DataFrame:
    """df with slot and shard of each row's key."""
    rows = df.withColumn("slot", slot_of(F.col(key), size)).drop("shard")
    return rows.join(F.broadcast(table(df.sparkSession, shards, size)), "slot", "left")


def write_shards(df: DataFrame, key: str, path: str, shards: int = SHARDS, files: int = 8, size: int = SIZE) -> None:
    """Write df partitioned by shard; each shard is salted over ``files`` tasks, so that none gathers one whole."""
    own, free = [F.col(f"`{c}`") for c in df.columns], "_salt"
    while free in {c.lower() for c in df.columns}:
        free += "_"
    salt = F.pmod(F.xxhash64(*own), F.lit(files)).cast("int")  # by content, so that a task that is run again deals its rows alike
    place(df.withColumn(free, salt), key, shards, size).repartition(shards * files, "shard", free).drop(free).write.partitionBy("shard").parquet(path)


def op5_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, "doc_id").select("doc_id", "slot", "shard")


ORACLE = f"""
WITH RECURSIVE pref AS (
  SELECT list(('0x' || substr(md5('offset:' || i), 1, 15))::BIGINT % {SIZE} ORDER BY i) AS o,
         list(('0x' || substr(md5('skip:' || i), 1, 15))::BIGINT % ({SIZE} - 1) + 1 ORDER BY i) AS k
  FROM range({SHARDS}) t(i)),
fill(turn, slots) AS (
  SELECT 0, []::BIGINT[]
  UNION ALL
  SELECT turn + 1, list_append(slots, (
    SELECT list_filter(list_transform(range({SIZE}), lambda j: (o[turn % {SHARDS} + 1] + j * k[turn % {SHARDS} + 1]) % {SIZE}),
                       lambda s: NOT list_contains(slots, s))[1] FROM pref))
  FROM fill WHERE turn < {SIZE}),
placed AS (SELECT unnest(slots) AS slot, generate_subscripts(slots, 1) - 1 AS turn FROM fill WHERE turn = {SIZE}),
h AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SIZE} AS slot FROM documents)
SELECT h.doc_id, h.slot::INTEGER AS slot, (p.turn % {SHARDS})::INTEGER AS shard FROM h JOIN placed p ON h.slot = p.slot
"""
