"""Control of the crawl queue as state of a stream: jobs, pauses, exclusive runs and aborts are events, and the state of a lane answers them in order.

A lane is one queue (of a pool of crawlers, say): its state is the jobs that wait, as a list, and its flags. Events of a batch are taken in order of `ord`.
The queue gives out `JOBS_PER_BATCH` jobs at a `drain` event, and, if a period is set, whenever its timer expires. A job whose run is to stop, as all are or all
but another one, is given out as cancelled. State lives in the checkpoint, so a restart goes on where the stream was.

Events: push (a job at the end), exclusive (the queue is cleared, the job is all that waits, others are to stop, and the schedule pauses), pause (with a run: others
are to stop), resume (no flag stays), abort (all, or all but a run), clear, finished (a run that others stopped for is over), drain, status.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomwork.streaming.crawl import JOBS_PER_BATCH

EVENTS = "lane string, ord long, kind string, source_id long, run_id long"
#: action: started, cancelled, dropped (from a cleared queue), refused (an unknown kind, or a job without a source), status.
ANSWERS = "lane string, ord long, action string, source_id long, run_id long, queue_length long, paused boolean, abort_all boolean, abort_except long"
JOB, FLAGS = "source_id long, run_id long", "paused boolean, abort_all boolean, abort_except long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _number(x) -> int | None:
    return None if x is None or pd.isna(x) else int(x)


class Lane(StatefulProcessor):
    def __init__(self, every_ms: int | None = None):
        self.every_ms = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getListState("jobs", JOB)
        self.flags = handle.getValueState("flags", FLAGS)

    def _read(self) -> None:
        self.waiting = [tuple(map(_number, j)) for j in self.jobs.get()] if self.jobs.exists() else []
        self.paused, self.abort_all, self.keep = (False, False, None)
        if self.flags.exists():
            paused, everything, keep = self.flags.get()
            self.paused, self.abort_all, self.keep = bool(paused), bool(everything), _number(keep)

    def _write(self) -> None:
        if self.waiting:
            self.jobs.put([*self.waiting])
        else:
            self.jobs.clear()
        self.flags.update((self.paused, self.abort_all, self.keep))

    def _answer(self, ord_: int | None, action: str, job: tuple = (None, None)) -> None:
        self.out.append((self.lane, ord_, action, *job, len(self.waiting), self.paused, self.abort_all, self.keep))

    def _stops(self, run: int | None) -> bool:
        return run is not None and (self.abort_all or (self.keep is not None and run != self.keep))

    def _give(self, ord_: int | None) -> None:
        for _ in range(min(JOBS_PER_BATCH, len(self.waiting))):
            job = self.waiting.pop(0)
            self._answer(ord_, "cancelled" if self._stops(job[1]) else "started", job)

    def _clear(self, ord_: int) -> None:
        gone, self.waiting = self.waiting, []
        for job in gone:
            self._answer(ord_, "dropped", job)

    def _take(self, ord_: int, kind: str, source: int | None, run: int | None) -> None:
        if kind in ("push", "exclusive") and source is None:
            self._answer(ord_, "refused", (source, run))
        elif kind == "push":
            self.waiting.append((source, run))
        elif kind == "exclusive":
            self._clear(ord_)
            self.waiting = [(source, run)]
            self.paused, self.abort_all, self.keep = True, False, run
        elif kind == "pause":
            self.paused, self.abort_all, self.keep = True, False, self.keep if run is None else run
        elif kind == "resume":
            self.paused, self.abort_all, self.keep = False, False, None
        elif kind == "abort":
            self.abort_all, self.keep = run is None, run
        elif kind == "clear":
            self._clear(ord_)
        elif kind == "finished":
            self.keep = None if run is not None and run == self.keep else self.keep
        elif kind == "drain":
            self._give(ord_)
        elif kind == "status":
            self._answer(ord_, "status")
        else:
            self._answer(ord_, "refused", (source, run))

    def _answers(self) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ANSWERS.split(", ")]
        frame = pd.DataFrame(self.out, columns=names)
        yield frame.astype({c: "Int64" for c in ("ord", "source_id", "run_id", "queue_length", "abort_except")} | {c: "boolean" for c in ("paused", "abort_all")})

    def _timer(self, now: int, ended: bool = False) -> None:
        """A timer while jobs wait. The one that has just expired is still listed while it is handled."""
        if self.every_ms is not None and self.waiting and (ended or not list(self.handle.listTimers())):
            self.handle.registerTimer(now + self.every_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.lane, self.out = key[0], []
        self._read()
        for r in pd.concat(list(rows)).sort_values(["ord", "kind"], kind="stable").itertuples(index=False):
            self._take(_number(r.ord), r.kind, _number(r.source_id), _number(r.run_id))
        self._write()
        if self.every_ms is not None:
            self._timer(timerValues.getCurrentProcessingTimeInMs())
        yield from self._answers()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.lane, self.out = key[0], []
        self._read()
        self._give(None)
        self._write()
        self._timer(timerValues.getCurrentProcessingTimeInMs(), ended=True)
        yield from self._answers()

    def close(self) -> None:
        pass


def controlled(spark: SparkSession, events: DataFrame, every_ms: int | None = None) -> DataFrame:
    """Answers to a stream of EVENTS; every_ms: how often a lane gives out jobs by itself. Keyed state needs the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return events.groupBy("lane").transformWithStateInPandas(Lane(every_ms), ANSWERS, "append", "None" if every_ms is None else "processingTime")
