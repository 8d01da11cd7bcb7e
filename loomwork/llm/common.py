"""Small helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.session import spread

#: The six ASCII blanks of `[^\x20\x09-\x0D]+`, as a Java character class.
BLANKS = r"[ \t\n\x0B\f\r]+"
#: Stands in for spark.checkpoint.dir where that is unset and everything runs on one machine (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Bytes of an Arrow batch, so that a Python worker's memory follows neither the table nor its longest texts; one text is never split.
BATCH_BYTES = 16 << 20
#: Rows up to which a side of a join is broadcast, by count; such rows are a few numbers each.
BROADCAST_ROWS = 200_000


#: Rows of documents up to which a table is dealt over all cores: its one file, or one group of rows, would be one task.
SPREAD_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents with these columns; larger tables keep their splits, as their texts would be shuffled whole."""
    return spread(table(spark, sf_dir, "documents").select(*columns), SPREAD_ROWS, larger=False)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local master, one machine, may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.getCheckpointDir():
        found = spark.sparkContext.getCheckpointDir().rsplit("/", 1)[0]
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found or LOCAL_CHECKPOINTS


#: What the innermost `own_tables` of this thread has seen written.
_OWN: ContextVar[list[str] | None] = ContextVar("own_tables", default=None)


def written(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and a lost executor costs no recomputation.

    Parquet rather than checkpoint(), whose files are uncompressed rows. The table stays until `discard` removes it, or the end of `own_tables` does:
    a result that is not yet computed may read it. kept: `own_tables` leaves it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/loomwork/{name}-{uuid.uuid4().hex}"
    if not kept and (own := _OWN.get()) is not None:
        own.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def own_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that `written` writes inside, in this thread, go at its end, also if it fails. Those of other queries of the same driver stay."""
    paths: list[str] = []
    token = _OWN.set(paths)
    try:
        yield
    finally:
        _OWN.reset(token)
        _remove(spark, paths)


def stored(make: Callable[[], DataFrame], path: str) -> DataFrame:
    """The result of a query, written to a path of the caller's; the tables that the query wrote on its way are removed."""
    spark = SparkSession.getActiveSession()
    with own_tables(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table of `written` that no plan reads any more."""
    _remove(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def _remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        with contextlib.suppress(Exception):  # a folder that is gone, or not to be removed, harms no result
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(spark: SparkSession, rows: int = 500) -> None:
    """Whole texts go to Python in small Arrow batches, bounded by rows and by bytes.

    Spark reads these settings when a plan is made ready to run, so they stay set for the session.
    """
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it is small by count; else the join may shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(name: str, columns: list[str]) -> str:
    """A column name that clashes with none of these."""
    taken = {c.lower() for c in columns}
    return next(x for i in range(len(taken) + 1) if (x := f"_{name}{i or ''}") not in taken)


def words(text: Column) -> Column:
    """Array of `[^\\x20\\x09-\\x0D]+` of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")
