"""The crawl queue's state over batches and restarts."""

import json
import time

import pytest

from loomwork.streaming import control


@pytest.fixture
def run(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    (tmp_path / "in").mkdir()
    n = [0]

    def step(events, every_ms=None):
        """One more file of events, read by a stream that starts anew from its checkpoint; all answers so far, in order."""
        n[0] += 1
        lines = [dict(zip(("lane", "ord", "kind", "source_id", "run_id"), e, strict=False)) for e in events]
        (tmp_path / "in" / f"{n[0]}.json").write_text("\n".join(map(json.dumps, lines)))
        answers = control.controlled(spark, spark.readStream.schema(control.EVENTS).json(str(tmp_path / "in")), every_ms)
        q = answers.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted(((r.lane, r.ord or 0, r.action, r.source_id or 0, r.run_id) for r in rows), key=lambda x: (x[0], x[1], x[3], str(x[4]))), rows

    yield step
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_events_over_batches_with_restarts(run):
    got, _ = run([("a", i, "push", i, 10 * i) for i in range(1, 6)] + [("b", 1, "push", 7, None), ("b", 2, "odd", 7, 1), ("b", 3, "push", None, 4)])
    assert got == [("b", 2, "refused", 7, 1), ("b", 3, "refused", 0, 4)]
    got, _ = run([("a", 6, "drain"), ("a", 7, "status"), ("b", 4, "drain")])  # after a restart: the first three, in order
    assert got[:3] == [("a", 6, "started", 1, 10), ("a", 6, "started", 2, 20), ("a", 6, "started", 3, 30)] and ("b", 4, "started", 7, None) in got
    got, rows = run([("a", 8, "exclusive", 9, 90), ("a", 9, "push", 1, 11), ("a", 10, "push", 2, None), ("a", 11, "status")])
    assert [x for x in got if x[1] == 8] == [("a", 8, "dropped", 4, 40), ("a", 8, "dropped", 5, 50)]
    status = next(r for r in rows if r.ord == 11)
    assert (status.queue_length, status.paused, status.abort_all, status.abort_except) == (3, True, False, 90)
    got, _ = run([("a", 12, "drain"), ("a", 13, "finished", None, 90), ("a", 14, "push", 3, 33), ("a", 15, "drain"), ("a", 16, "status")])
    assert [x[2:] for x in got if x[1] == 12] == [("cancelled", 1, 11), ("started", 2, None), ("started", 9, 90)]
    assert [x[2:] for x in got if x[1] == 15] == [("started", 3, 33)]
    got, rows = run([("a", 17, "abort"), ("a", 18, "push", 1, 1), ("a", 19, "drain"), ("a", 20, "resume"), ("a", 21, "push", 1, 2), ("a", 22, "clear"), ("a", 23, "pause", None, 5), ("a", 24, "status")])
    assert [x[1:] for x in got if x[1] in (19, 22)] == [(19, "cancelled", 1, 1), (22, "dropped", 1, 2)]
    status = next(r for r in rows if r.ord == 24)
    assert (status.queue_length, status.paused, status.abort_all, status.abort_except) == (0, True, False, 5)


def test_timers_give_out_jobs(spark, tmp_path):
    """With a period a stream has work as long as a timer may expire, so it runs until it is stopped."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(dict(lane="a", ord=i, kind="push", source_id=i, run_id=i)) for i in range(1, 6)))
    answers = control.controlled(spark, spark.readStream.schema(control.EVENTS).json(str(tmp_path / "in")), 50)
    q = answers.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="100 milliseconds").start()
    try:
        deadline, got = time.time() + 90, []
        while len(got) < 5 and time.time() < deadline:
            time.sleep(1)
            if (tmp_path / "out" / "_spark_metadata").exists():
                got = sorted(r.source_id for r in spark.read.schema(control.ANSWERS).parquet(str(tmp_path / "out")).where("action = 'started'").collect())
    finally:
        q.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert got == [1, 2, 3, 4, 5]
