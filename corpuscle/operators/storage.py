"""Written tables: lineage cuts in the shared folder, keyed upsert, manifest checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir. Where that is unset, a local master gets a temporary one; any other is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        master = spark.sparkContext.master
        if not set_.isDefined() and not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = set_.get() if set_.isDefined() else "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(target: DataFrame, updates: DataFrame, key: str, vector: str | None = None, dim: int | None = None) -> DataFrame:
    """Rows of the updated keys are replaced; of updates with one key the greatest by the other columns, in their order, counts.

    With ``vector``, a wrong dimension raises when the result is read.
    """
    if vector is not None and dim is not None:
        ok = F.assert_true(F.size(vector) == dim, F.lit(f"vectors must have dimension {dim}"))
        updates = updates.where(ok.isNull())
    rest = [c for c in updates.columns if c != key]
    newest = updates.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest)) if rest else updates.distinct()
    return target.join(updates.select(key).distinct(), key, "left_anti").unionByName(newest)


TEXT_LIMIT, BINARY_LIMIT = 20 << 20, 100 << 20


def verify_manifest(manifest: DataFrame, files: DataFrame, types: list[str], total_limit: int, key: str | None = None) -> DataFrame:
    """relative_path, staged_id, status of each manifest row: the first failing check, else ok; files nobody lists are ``unlisted``.

    manifest: staged_id, relative_path, media_type, size_bytes, sha256; files: path, length, sha256. A row's file is the one at its path or,
    with ``key``, a column of both, the one with its key; then paths may repeat among the files. That path or key is unique among the files.
    A size or hash that is null on either side is a mismatch.
    """
    by = lambda c: F.count("*").over(Window.partitionBy(c))
    m = manifest.withColumn("n_path", by("relative_path")).withColumn("n_id", by("staged_id")).withColumn("at", F.col(key or "relative_path"))
    total = manifest.agg(F.sum("size_bytes").alias("total"))
    f = files.select(F.col(key or "path").alias("at"), F.col("path").alias("f_path"), F.col("length").alias("f_size"), F.col("sha256").alias("f_sha"), F.lit(True).alias("present"))
    out = m.join(f, "at", "full_outer").join(F.broadcast(total))
    differ = lambda a, b: ~F.coalesce(F.col(a) == F.col(b), F.lit(False))
    limit = F.when(F.col("media_type").startswith("text/"), TEXT_LIMIT).otherwise(BINARY_LIMIT)
    status = (
        F.when(F.col("staged_id").isNull(), "unlisted")
        .when(F.col("n_path") > 1, "duplicate_path")
        .when(F.col("n_id") > 1, "duplicate_id")
        .when(~F.col("media_type").isin(*types), "unsupported_type")
        .when(F.col("size_bytes") > limit, "too_large")
        .when(F.col("total") > total_limit, "total_too_large")
        .when(F.col("present").isNull(), "missing")
        .when(differ("size_bytes", "f_size"), "size_mismatch")
        .when(differ("sha256", "f_sha"), "hash_mismatch")
        .otherwise("ok")
    )
    return out.select(F.coalesce("relative_path", "f_path").alias("relative_path"), "staged_id", status.alias("status"))
