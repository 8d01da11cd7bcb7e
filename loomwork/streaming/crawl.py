"""Crawl control as Structured Streaming: due sources polled into a queue of files, drained a few at a time, and content changes with kept state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwork.functions.dates import is_due
from loomwork.operators.runs import crawl_jobs, should_abort

JOBS_PER_BATCH = 3
PAGE_SCHEMA = "source_id long, url string, raw_text string, fetched_ord long"


def queue(spark: SparkSession, folder: str) -> DataFrame:
    """One line a job, a file a job: at most three files enter a batch, oldest first."""
    items = spark.readStream.option("maxFilesPerTrigger", JOBS_PER_BATCH).text(folder).withColumnRenamed("value", "item")
    return crawl_jobs(items)


def drain(
    spark: SparkSession, folder: str, checkpoint: str, target: str, control: Callable[[], tuple[bool, int | None]] = lambda: (False, None)
) -> StreamingQuery:
    """Write the queue's jobs to target/batch=N, once each: a batch that runs again replaces its own folder.

    control gives abort_all and abort_except, read anew for every batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        everything, keep = control()
        stop = should_abort(F.col("run_id"), F.lit(everything), F.lit(keep).cast("long"))
        batch.withColumn("status", F.when(stop, "cancelled").otherwise("started")).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return queue(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _differs(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(parts)).sort_values("fetched_ord")
    out = []
    for r in rows.itertuples(index=False):
        if r.content_hash != last:
            last = r.content_hash
            out.append((r.source_id, r.url, r.content_hash, r.fetched_ord))
    if last is not None:
        state.update((last,))
    yield pd.DataFrame(out, columns=["source_id", "url", "content_hash", "fetched_ord"])


def changed(pages: DataFrame) -> DataFrame:
    """Pages whose content differs from what was last seen at their address, over all batches.

    Only the last hash of an address is kept as state. Texts under 40 characters never count.
    """
    hashed = pages.where(F.length("raw_text") >= 40).withColumn("content_hash", F.sha2("raw_text", 256)).drop("raw_text")
    return hashed.groupBy("source_id", "url").applyInPandasWithState(
        _differs,
        "source_id long, url string, content_hash string, fetched_ord long",
        "content_hash string",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def queue_status(waiting: DataFrame, paused: bool, abort_all: bool, abort_except: int | None) -> DataFrame:
    return waiting.agg(F.count("*").alias("queue_length")).select(
        "queue_length", F.lit(paused).alias("schedule_paused"), F.lit(abort_all).alias("abort_all"), F.lit(abort_except).cast("long").alias("abort_except_run_id")
    )


def poll(spark: SparkSession, sources: Callable[[], DataFrame], folder: str, checkpoint: str, every: str = "5 minutes", once: bool = False) -> StreamingQuery:
    """Puts due sources into the queue's folder, `source_id` a line and a file, at every trigger.

    sources gives (source_id, enabled, status, last_checked, every_minutes) as they stand then; the clock is a rate stream, and a batch that runs
    again writes the same files. once: a single trigger, for tests and external schedulers.
    """

    def enqueue(_: DataFrame, batch_id: int) -> None:
        due = sources().where(is_due(F.col("enabled"), F.col("status"), F.col("last_checked"), F.col("every_minutes"), F.current_timestamp()))
        due.select(F.col("source_id").cast("string")).repartition("source_id").write.mode("overwrite").text(f"{folder}/poll={batch_id}")

    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    clock = clock.writeStream.foreachBatch(enqueue).option("checkpointLocation", checkpoint)
    return (clock.trigger(once=True) if once else clock.trigger(processingTime=every)).start()
