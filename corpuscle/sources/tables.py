"""Named Parquet tables below a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


#: Bytes up to which a table is dealt out before costly work on its rows.
SMALL = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small input dealt over all cores; a large one as it is.

    A file is split by its row groups only, so a small table may come out of one task whatever the number of cores. What moves is at most
    SMALL bytes of files; beyond that there are row groups enough.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df
