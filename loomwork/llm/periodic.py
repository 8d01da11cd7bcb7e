"""Periodic run detection: maximal repetitions of words in a text, by a harmonic grid and prefix hashes.

A run is a stretch [start, start + length) of consecutive words with smallest period p (words p apart are identical), of length
at least max(`LEAST`, `TIMES` * p), that no neighbouring word extends keeping its period. Every period p has the grid points 0, p, 2p, ...: about
n ln n pairs of (period, grid point) for n words. The words that equal the word p further make a stretch of at least (TIMES - 1) * p words, so it
holds a whole cell of the grid and begins at most p words before one: a pair goes on only if the cells at its grid point and one period further
have equal hashes. For all those pairs at once a binary search over prefix hashes finds how far the text and the text p words on agree after the
grid point, and another how far before it (their longest common extensions). The words of the stretches found are then compared, and a stretch
that two hashes of 31 bits wrongly joined is measured again word by word. Equal stretches, found from several grid points or under multiples of
their period, count once, with the smallest period, which is then the smallest period of their words.

Pairs are made in blocks of `PAIRS`, so memory follows a text's words and not their pairs. Texts are judged one by one in Arrow batches; nothing
is shuffled, and a lost executor costs its own tasks only.

Words are `[^\\x20\\x09-\\x0D]+`. Defined cases: null and empty texts have no words and no run; repeated rows are judged alike, row by row; a null doc_id
leaves its text as it is (`planted`); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import documents, text_batches, words

LEAST, TIMES = 24, 3
#: Pairs of (period, grid point) in a block.
PAIRS = 1 << 20
#: Two prime moduli below 2^31, so that products fit 64 bits, and a base for each.
MODULI = ((np.uint64(2147483647), np.uint64(1103515245)), (np.uint64(2147483629), np.uint64(1664525213)))
RUNS = "start long, length long, period long"


class PrefixHashes:
    """Hashes of any stretch of a sequence of numbers, from running sums of word * base^place."""

    def __init__(self, ids: np.ndarray):
        self.parts = []
        for m, base in MODULI:
            power = np.ones(len(ids) + 1, np.uint64)
            done, step = 1, base % m  # by doubling: the first `done` powers times base^done are the next
            while done < len(power):
                more = min(done, len(power) - done)
                power[done : done + more] = power[:more] * step % m
                step, done = step * step % m, done + more
            sums = np.zeros(len(ids) + 1, np.uint64)
            # Numbers are spread, as small ones would make small sums; a sum of n numbers below 2^31 fits for any n below 2^33.
            spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(2654435761) % m
            np.cumsum(spread * power[:-1] % m, out=sums[1:])
            self.parts.append((m, sums % m, power))

    def equal(self, a: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of these lengths at a and at a + shift have equal hashes."""
        out = np.ones(len(a), bool)
        b = a + shift
        for m, sums, power in self.parts:
            left, right = (sums[a + length] + m - sums[a]) % m, (sums[b + length] + m - sums[b]) % m
            out &= left * power[shift] % m == right
        return out


def grid(n: int, times: int = TIMES, pairs: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (period, grid point): every multiple of every period up to n // times with a whole cell at it and one after it."""
    period = np.arange(1, n // times + 1, dtype=np.int64)
    total = np.cumsum(n // period - 1)
    done = 0
    while done < len(period):
        before = int(total[done - 1]) if done else 0
        stop = max(done + 1, int(np.searchsorted(total, before + pairs, "right")))
        own = period[done:stop]
        points = n // own - 1
        place = np.arange(int(points.sum()), dtype=np.int64) - np.repeat(np.cumsum(points) - points, points)
        p = np.repeat(own, points)
        for at in range(0, len(p), pairs):  # a period of very many points is a block of its own, cut up
            yield p[at : at + pairs], (place * p)[at : at + pairs]
        done = stop


def extensions(h: PrefixHashes, n: int, p: np.ndarray, at: np.ndarray, back: bool) -> np.ndarray:
    """How many words from `at` on, or before it, equal the word p further: a binary search for all pairs at once."""
    low, high = np.zeros(len(p), np.int64), at.copy() if back else n - p - at
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_] + 1) // 2
        begin = at[open_] - mid if back else at[open_]
        same = h.equal(begin, p[open_], mid)
        low[open_[same]] = mid[same]
        high[open_[~same]] = mid[~same] - 1
    return low


def _plain(ids: np.ndarray, p: int, begin: int, end: int) -> list[tuple[int, int]]:
    """The stretches between begin and end of words that equal the word p further, word by word."""
    other = [begin - 1, *(begin + np.flatnonzero(ids[begin:end] != ids[begin + p : end + p])).tolist(), end]
    return [(a + 1, z) for a, z in zip(other, other[1:]) if z > a + 1]


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES, pairs: int = PAIRS) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of numbers, by start, then period. times: at least 3, so that a run holds a whole cell of its grid."""
    n = len(ids)
    if n < least:
        return np.empty((0, 3), np.int64)
    h, found = PrefixHashes(ids), []
    for p, at in grid(n, times, pairs):
        same = ids[at] == ids[at + p]
        p, at = p[same], at[same]
        same = h.equal(at, p, p)
        p, at = p[same], at[same]
        if not len(p):
            continue
        begin, end = at - extensions(h, n, p, at, True), at + extensions(h, n, p, at, False)
        # The words decide. Equal words never have other hashes, so a stretch is too long, if anything.
        for period, a, z in np.unique(np.column_stack([p, begin, end]), axis=0).tolist():
            whole = np.array_equal(ids[a:z], ids[a + period : z + period])
            for own, stop in [(a, z)] if whole else _plain(ids, period, a, z):
                if stop - own + period >= max(least, times * period):
                    found.append((own, stop - own + period, period))
    if not found:
        return np.empty((0, 3), np.int64)
    rows = np.unique(np.array(found, np.int64), axis=0)  # by start, length, period
    rows = rows[np.append(True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1]))]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run has after its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(cover)[:-1] == 0


def _numbered(found: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        runs, texts = [], []
        for text in batch["text"].to_pylist():
            found = (text or "").encode("utf-8", "replace").split()
            own = find_runs(_numbered(found))
            runs.append([{"start": s, "length": z, "period": p} for s, z, p in own.tolist()])
            if len(own):
                found = [found[i] for i in np.flatnonzero(kept_words(len(found), own)).tolist()]
            texts.append(b" ".join(found).decode())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(runs, kind), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])


def collapsed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, runs array<struct<start, length, period>> by start and period, collapsed: the words that stay, with single blanks."""
    text_batches(docs.sparkSession)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_collapse, f"doc_id {kind}, runs array<struct<{RUNS.replace(' long', ': bigint')}>>, collapsed string")


def longest(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties go to the smallest start, then period. Null without a run."""
    none = F.lit(None).cast(f"struct<{RUNS.replace(' long', ': bigint')}>")
    # Runs come by start and period, so the first of equals stays.
    return F.aggregate(runs, none, lambda a, x: F.when(a.isNull() | (x.length * a.period > a.length * x.period), x).otherwise(a))


def planted(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) where a tenth of the texts, by crc32 of the doc_id, repeats some of its own words from a place on, as the query's contract says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w, g = words(F.col("text")), F.floor(h / 10)
    own = docs.select("doc_id", "text", F.when(h % 10 == 0, w).alias("w"), g.alias("g"))
    own = own.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    own = own.withColumn("p", F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1)
    again = F.transform(F.col("w"), lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return own.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapsed(planted(documents(spark, sf_dir, "doc_id", "text"))).withColumn("best", longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

