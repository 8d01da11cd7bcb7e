"""A session with the settings that these jobs are written for; on a cluster the cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS, SPREAD_ROWS = 200_000, 200_000
#: Rows of a task of a larger table that is spread.
DEALT = 20_000
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "loomwork", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    for key, value in (DEFAULTS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of spark.checkpoint.dir; only a local master, one machine, may do without that setting."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or "/tmp/checkpoints")
    return df.checkpoint()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it is as small as a dimension is, by count; else the join may shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, rows: int = SPREAD_ROWS, larger: bool = True, by: str | None = None) -> DataFrame:
    """A table over all cores, for heavy expressions: its one file, or a few coalesced partitions of a shuffle, would be few tasks.

    A small table is dealt to the cores, a larger one to tasks of `DEALT` rows, however few bytes they are. larger: false where that
    would shuffle whole texts; a larger table keeps its splits then, and only up to `rows` rows are shuffled. by: rows that share this column come
    together, so what is grouped by it later is not shuffled again; best called on narrow rows, before texts are made of them.
    """
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    keys = [by] if by else []
    if n <= rows:
        return df.repartition(max(1, min(cores, n // 64)), *keys)
    return df.repartition(max(cores, -(-n // DEALT)), *keys) if larger else df
