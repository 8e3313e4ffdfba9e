"""Keyed state of foreachBatch streams: hash buckets of Parquet files, with a manifest for each epoch.

A batch writes only the rows it changes, as one more file for each bucket it touches; reading a key opens its bucket's files alone and
takes the newest row of each key. Files of a bucket are merged size tier by size tier (``FAN`` files of one tier make one of
the next; more changed rows than half of the base make a new base, without removed keys), so a row is rewritten a
logarithmic number of times and a bucket has a logarithmic number of files, whatever the number of batches.

An epoch is committed by its manifest, the list of live files. It is written last and as one file, so a batch that dies leaves no
trace, and an epoch that runs again starts from the newest manifest before it and gives the same. The last ``KEEP`` manifests
stay; files that none of them names are deleted. The driver holds a manifest: a few rows for each bucket.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files of one size tier in a bucket that are merged into one of the next tier.
FAN = 4
#: Manifests kept: the newest one and the one that its epoch starts from if it runs again.
KEEP = 2

_FILES = "bucket int, path string, rows long, base boolean"


class KeyedState:
    """A table below ``root`` with one row for each key, changed epoch by epoch. ``initial`` counts only where there is none yet.

    ``by`` are the columns that choose the bucket, a prefix of the key (all of it if not given): rows that are read and replaced
    together, such as the chunks of a page, then lie in one bucket.
    """

    def __init__(self, root: str, initial: DataFrame, key: list[str], by: list[str] | None = None, buckets: int = 64):
        self.root, self.spark, self.key, self.by, self.buckets = root.rstrip("/"), initial.sparkSession, key, by or key, buckets
        self.columns = initial.columns
        self.schema = initial.withColumns({"_epoch": F.lit(0).cast("long"), "_gone": F.lit(False)}).schema
        if self._manifest(None) is None:
            self._commit(-1, [], initial, None)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def current(self, before: int | None = None) -> DataFrame:
        """All rows after the newest epoch, or the newest one before the given one."""
        return self._live(self._manifest(before) or [])

    def near(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The rows in the buckets of ``keys`` (which has the columns ``by``): nothing else is read."""
        touched = {r[0] for r in keys.select(self.bucket()).distinct().collect()}
        return self._live([f for f in self._manifest(before) or [] if f["bucket"] in touched])

    def apply(self, epoch: int, changed: DataFrame, gone: DataFrame | None = None) -> None:
        """Commit an epoch: rows of ``changed`` replace those of their keys, keys of ``gone`` are removed.

        A key that is in both is changed; of a key that repeats within one of them, one row counts.
        """
        self._commit(epoch, self._manifest(epoch) or [], changed, gone)

    def files(self) -> list[dict]:
        """The live files: bucket, path, rows, base."""
        return self._manifest(None) or []

    # ---- files

    def _manifest(self, before: int | None) -> list[dict] | None:
        try:
            log = self.spark.read.schema(f"{_FILES}, epoch long").parquet(f"{self.root}/manifest")
        except AnalysisException:
            return None
        epochs = log if before is None else log.where(F.col("epoch") < before)
        newest = epochs.agg(F.max("epoch")).first()[0]
        if newest is None:
            return None
        return [r.asDict() for r in log.where((F.col("epoch") == newest) & (F.col("bucket") >= 0)).drop("epoch").collect()]

    def _raw(self, files: list[dict]) -> DataFrame:
        paths = [f["path"] for f in files]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.key]
        last = F.max_by(F.struct(*rest), F.struct("_epoch", ~F.col("_gone"))).alias("_r")
        return rows.groupBy(*self.key).agg(last).select(*self.key, *(F.col(f"_r.{c}").alias(c) for c in rest))

    def _live(self, files: list[dict]) -> DataFrame:
        """Buckets of a base alone are read as they are; the others' rows are resolved by key."""
        mixed = {f["bucket"] for f in files if not f["base"]}
        plain = self._raw([f for f in files if f["bucket"] not in mixed])
        rows = self._newest(self._raw([f for f in files if f["bucket"] in mixed])) if mixed else plain.limit(0)
        return plain.unionByName(rows).where(~F.col("_gone")).select(*self.columns)

    def _write(self, rows: DataFrame, epoch: int, base: bool) -> list[dict]:
        """Write rows, a file or a few for each bucket, and list what was written."""
        folder = f"{self.root}/data/{epoch:012d}-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self.bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        try:
            sizes = self.spark.read.parquet(folder).groupBy("_bucket").count().collect()
        except AnalysisException:  # no rows, no files
            return []
        return [{"bucket": b, "path": f"{folder}/_bucket={b}", "rows": n, "base": base} for b, n in sizes]

    def _commit(self, epoch: int, files: list[dict], changed: DataFrame, gone: DataFrame | None) -> None:
        marks = {"_epoch": F.lit(epoch).cast("long"), "_gone": F.lit(False)}
        rows = changed.select(*self.columns).withColumns(marks)
        if gone is not None:
            rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in (*self.key, *marks)]
            rows = rows.unionByName(gone.select(*self.key, *rest).withColumns(marks | {"_gone": F.lit(True)}))
        rows = self._newest(rows)
        first = not files and gone is None
        files = files + self._write(rows, epoch, first)
        files = self._merged(epoch, files)
        entries = [(f["bucket"], f["path"], f["rows"], f["base"]) for f in files]
        listed = self.spark.createDataFrame([(-1, "", 0, False), *entries], _FILES)  # the first row marks an empty table's epoch
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/epoch={epoch}")
        self._clean()

    def _merged(self, epoch: int, files: list[dict]) -> list[dict]:
        by_bucket, whole, some = defaultdict(list), [], []
        for f in files:
            by_bucket[f["bucket"]].append(f)
        for listed in by_bucket.values():
            base, deltas = [f for f in listed if f["base"]], [f for f in listed if not f["base"]]
            if deltas and 2 * sum(f["rows"] for f in deltas) >= sum(f["rows"] for f in base):
                whole += listed
                continue
            tiers = defaultdict(list)
            for f in deltas:
                tiers[int(math.log(max(f["rows"], 1), FAN))].append(f)
            for tier in tiers.values():
                if len(tier) >= FAN:
                    some += tier
        out = [f for f in files if f not in whole and f not in some]
        if whole:
            out += self._write(self._newest(self._raw(whole)).where(~F.col("_gone")), epoch, True)
        if some:
            out += self._write(self._newest(self._raw(some)), epoch, False)
        return out

    def _clean(self) -> None:
        """Delete manifests but the last KEEP, and files that those don't name."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        manifests = sorted((int(s.getPath().getName().removeprefix("epoch=")), s.getPath()) for s in fs.listStatus(path(f"{self.root}/manifest")) if s.getPath().getName().startswith("epoch="))
        for _, old in manifests[:-KEEP]:
            fs.delete(old, True)
        live = {r[0].split("/data/")[-1] for r in self.spark.read.schema(f"{_FILES}, epoch long").parquet(f"{self.root}/manifest").select("path").distinct().collect()}
        for folder in fs.listStatus(path(f"{self.root}/data")) if fs.exists(path(f"{self.root}/data")) else []:
            parts = [s.getPath() for s in fs.listStatus(folder.getPath()) if s.getPath().getName().startswith("_bucket=")]
            dead = [p for p in parts if f"{folder.getPath().getName()}/{p.getName()}" not in live]
            for p in [folder.getPath()] if len(dead) == len(parts) else dead:
                fs.delete(p, True)
