"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Pieces of one length are interchangeable, so an instance is its histogram: at most `LENGTH` counts, whatever the input. A solution
is a set of groups: patterns (lengths that share a sequence) with how many sequences have them. The algorithm (Falkenauer, 1996)
works on groups: a crossover injects whole well-filled sequences of one parent into the other, sequences that held the same pieces,
and those that are badly filled, are taken apart, and the pieces that this displaces are put back by best fit, largest first.
Each island is a row of a DataFrame that evolves its own population in a task, from best fit over the lengths in random orders; after each
epoch the states are written and every island's elite migrates to the next by a join. A bound (Martello and Toth's L2) ends the search
after an epoch when nothing can be gained any more. Should the islands end behind plain best-fit-decreasing, that packing
joins all of them as a guest for a last epoch, so the result is never worse. `Report` says what happened.

Texts are tokenized once, in the tasks that read them; each task numbers its pieces of every length, the counts of all tasks
give the numbers offsets, and the plan says which numbers of a length go to which sequence. No piece is shuffled for packing but
to meet its offset.

Defined cases: a null or empty text is one piece that holds only the end mark; repeated rows are packed each; a null doc_id
passes through; empty tables give no rows; other columns are ignored. Only documents of more than LENGTH tokens are cut,
the first piece being what is left of whole pieces.
"""

from __future__ import annotations

import base64
import json
import logging
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.llm.common import documents, text_batches, written

LENGTH = 2048
END = 0
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 4, 4, 8, 4
#: Room up to which a sequence counts as well filled.
SLACK = 2
SPECIAL = "<|endoftext|>"

Pattern = tuple[int, ...]
Groups = dict[Pattern, int]


@dataclass(frozen=True)
class Report:
    """Numbers of sequences: best-fit-decreasing, the lower bound, and what the islands found; crossovers and epochs that ran."""

    best_fit: int
    bound: int
    found: int
    crossovers: int
    epochs: int


@cache
def _encoders(vocabulary: str | None):
    """The tokenizer file's encoder, and a faster one over the same vocabulary for texts without its special token."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    if vocabulary:
        return exact, None
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return exact, tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, vocabulary: str | None = None) -> np.ndarray:
    exact, fast = _encoders(vocabulary)
    text = (text or "").encode("utf-8", "replace").decode()
    if fast is None or SPECIAL in text:
        ids = exact.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_ordinary(text)
    return np.array([*ids, END], "<u4")


def cut(n: int) -> list[tuple[int, int]]:
    """Starts and lengths of the pieces of n tokens."""
    first = n % LENGTH or min(n, LENGTH)
    return [(0, first), *((s, LENGTH) for s in range(first, n, LENGTH))]


def pieces(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, number): number counts the task's pieces of that length."""
    text_batches(docs.sparkSession)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(LENGTH + 1, np.int64)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = token_ids(text, vocabulary)
                for k, (start, n) in enumerate(cut(len(ids))):
                    rows.append((doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), task, int(seen[n])))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = zip(*rows, strict=True) if rows else ((),) * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        tokenize, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"
    )


class Rooms:
    """Sequences by the room that they have left; the least sufficient room is found in a bit set."""

    def __init__(self, groups: Groups = {}):  # noqa: B006
        self.at: dict[int, Groups] = {}
        self.bits = 0
        for pattern, n in groups.items():
            self.add(pattern, n)

    def add(self, pattern: Pattern, n: int) -> None:
        room = LENGTH - sum(pattern)
        here = self.at.setdefault(room, {})
        here[pattern] = here.get(pattern, 0) + n
        self.bits |= 1 << room

    def best_fit(self, length: int, n: int) -> None:
        """n pieces of a length, one after the other, each into the tightest sequence that has room."""
        while n:
            above = self.bits >> length
            if not above:
                per = LENGTH // length
                if n >= per:
                    self.add((length,) * per, n // per)
                if n % per:
                    self.add((length,) * (n % per), 1)
                return
            room = length + (above & -above).bit_length() - 1
            here = self.at[room]
            pattern, many = here.popitem()
            per = room // length  # a sequence stays the tightest until it is full
            full = min(many, n // per)
            if full:
                self.add(tuple(sorted(pattern + (length,) * per, reverse=True)), full)
                n -= full * per
                many -= full
            if many and n:  # fewer are left than one sequence takes
                self.add(tuple(sorted(pattern + (length,) * n, reverse=True)), 1)
                n, many = 0, many - 1
            if many:
                here[pattern] = here.get(pattern, 0) + many
            elif not here:
                del self.at[room]
                self.bits &= ~(1 << room)

    def groups(self) -> Groups:
        out: Groups = {}
        for here in self.at.values():
            for pattern, n in here.items():
                out[pattern] = out.get(pattern, 0) + n
        return out


def best_fit_decreasing(counts: np.ndarray, into: Groups = {}) -> Groups:  # noqa: B006
    rooms = Rooms(into)
    for length in np.flatnonzero(counts)[::-1].tolist():
        rooms.best_fit(length, int(counts[length]))
    return rooms.groups()


def size(groups: Groups) -> int:
    return sum(groups.values())


def fitness(groups: Groups) -> tuple[int, float]:
    """Fewer sequences, then fuller ones: Falkenauer's mean square of the fill, negated."""
    n = size(groups)
    return n, -sum((sum(p) / LENGTH) ** 2 * k for p, k in groups.items()) / max(1, n)


def least_sequences(counts: np.ndarray) -> int:
    """Martello and Toth's bound L2 on the number of sequences."""
    x = np.arange(LENGTH + 1)
    n, s = np.cumsum(counts), np.cumsum(counts * x)
    half = LENGTH // 2
    best = -(-int(s[-1]) // LENGTH)
    for a in range(1, half + 1):
        big = int(n[-1] - n[LENGTH - a])
        middle, middle_sum = int(n[LENGTH - a] - n[half]), int(s[LENGTH - a] - s[half])
        small = int(s[half] - s[a - 1])
        best = max(best, big + middle + max(0, -(-(small - (middle * LENGTH - middle_sum)) // LENGTH)))
    return best


def crossover(one: Groups, two: Groups, rng: np.random.Generator) -> Groups:
    """Well-filled sequences of `two` go whole into `one`; what they displace, and what was badly filled, is put back by best fit."""
    full = [p for p in two if sum(p) >= LENGTH - SLACK]
    chosen = [p for p, x in zip(full, rng.random(len(full)), strict=True) if x < 0.5]
    child = dict(one)
    owed = np.zeros(LENGTH + 1, np.int64)
    injected: Groups = {}
    for p in chosen:
        n = max(0, two[p] - one.get(p, 0))  # those that both have need no exchange
        if n:
            injected[p] = n
            for x in p:
                owed[x] += n
    loose = np.zeros(LENGTH + 1, np.int64)
    for p in sorted(child, key=lambda p: (sum(p), p)):  # the emptiest first
        n = child[p] if sum(p) < LENGTH - SLACK else min(child[p], max((int(owed[x]) for x in p), default=0))
        if n:
            child[p] -= n
            if not child[p]:
                del child[p]
            for x in p:
                paid = min(n, int(owed[x]))  # the injected sequences have these already
                owed[x] -= paid
                loose[x] += n - paid
    child = best_fit_decreasing(loose, child)
    for p, n in injected.items():
        child[p] = child.get(p, 0) + n
    return child


def mutation(groups: Groups, rng: np.random.Generator) -> Groups:
    """Some of the emptiest sequences and a few others are taken apart and packed again."""
    out, loose = dict(groups), np.zeros(LENGTH + 1, np.int64)
    order = sorted(out, key=sum)
    some = order[: max(1, len(order) // 50)] + [order[i] for i in rng.integers(0, len(order), max(1, len(order) // 50))]
    for p in set(some):
        for x in p:
            loose[x] += out[p]
        del out[p]
    lengths = np.flatnonzero(loose)
    rng.shuffle(lengths)
    rooms = Rooms(out)
    for x in sorted(lengths.tolist(), reverse=True) if rng.random() < 0.5 else lengths.tolist():
        rooms.best_fit(x, int(loose[x]))
    return rooms.groups()


def random_fit(counts: np.ndarray, rng: np.random.Generator) -> Groups:
    """Best fit over the lengths in a random order."""
    rooms, lengths = Rooms(), np.flatnonzero(counts)
    rng.shuffle(lengths)
    for x in lengths.tolist():
        rooms.best_fit(x, int(counts[x]))
    return rooms.groups()


def evolve(population: list[Groups], bound: int, rng: np.random.Generator, generations: int = GENERATIONS) -> tuple[list[Groups], int]:
    """The population after some generations, one at least, best first, and how many crossovers made it. The best is never lost."""
    population, crossovers = sorted(population, key=fitness), 0
    for _ in range(generations):
        pairs = [sorted(rng.choice(len(population), 2, replace=False)) if len(population) > 1 else (0, 0) for _ in population]
        young = []
        for k, (a, b) in enumerate(pairs):
            child = crossover(population[a], population[b], rng) if k % 2 else crossover(population[b], population[a], rng)
            crossovers += 1
            young.append(mutation(child, rng) if rng.random() < 0.2 else child)
        known, ranked = set(), []
        for groups in sorted([*population, *young], key=fitness):
            if (f := fitness(groups)) not in known:  # copies of one solution would crowd the others out
                known.add(f)
                ranked.append(groups)
        population = ranked[: max(2, len(population))]
        if size(population[0]) <= bound:
            break
    return population, crossovers


def _stored(population: list[Groups]) -> str:
    return json.dumps([list(g.items()) for g in population])


def _loaded(text: str) -> list[Groups]:
    return [{tuple(p): n for p, n in g} for g in json.loads(text)]


def evolved(spark: SparkSession, counts: np.ndarray, islands: int = ISLANDS, epochs: int = EPOCHS) -> tuple[Groups, Report]:
    """The best groups that the islands find for counts[length] pieces of each length below LENGTH, and how they came about."""
    start, bound = best_fit_decreasing(counts), least_sequences(counts)
    if not start:
        return start, Report(0, bound, 0, 0, 0)

    def epoch(k: int):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for island, state, guest in part[["island", "state", "guest"]].itertuples(index=False):
                    rng = np.random.default_rng([k, island])
                    population = _loaded(state) if state else [random_fit(counts, rng) for _ in range(POPULATION)]
                    population, n = evolve(population + (_loaded(guest) if guest else []), bound, rng)
                    best = population[:POPULATION]
                    yield pd.DataFrame({"island": [island], "state": [_stored(best)], "elite": [_stored(best[:1])], "size": [size(best[0])], "fill": [fitness(best[0])[1]], "crossovers": [n]})

        return run

    state = spark.range(islands).select(F.col("id").alias("island"), F.lit("").alias("state"), F.lit("").alias("guest"))
    crossovers = k = 0
    while True:
        # repartitionById: each island is a task of its own
        own = written(
            state.repartitionById(islands, F.col("island").cast("int")).mapInPandas(epoch(k), "island long, state string, elite string, size long, fill double, crossovers long"), "islands"
        )
        least, ran = own.agg(F.min("size"), F.sum("crossovers")).first()
        crossovers, k = crossovers + ran, k + 1
        if least <= bound or k > epochs or k == epochs and least <= size(start):
            break
        guests = own.select(F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("guest"))
        state = own.select("island", "state").join(guests, "island")
        if k == epochs:
            state = state.withColumn("guest", F.lit(_stored([start])))
    best = _loaded(own.orderBy("size", "fill", "island").select("elite").first()[0])[0]
    report = Report(size(start), bound, size(best), crossovers, k)
    logging.getLogger(__name__).info("packing: %s", report)
    return best, report


def plan(spark: SparkSession, counts: np.ndarray, islands: int = ISLANDS, epochs: int = EPOCHS) -> Groups:
    return evolved(spark, counts, islands, epochs)[0]


class Places:
    """Where the pieces of each length go: number -> sequence and offset."""

    def __init__(self, groups: Groups):
        rows: dict[int, list] = {}
        taken, sequence = np.zeros(LENGTH + 1, np.int64), 0
        for p, n in sorted(groups.items()):
            offset = 0
            for x in p:
                rows.setdefault(x, []).append((int(taken[x]), sequence, offset))
                taken[x] += n
                offset += x
            sequence += n
        self.rows = {x: np.array(r, np.int64) for x, r in rows.items()}
        self.rows[LENGTH] = np.array([(0, sequence, 0)], np.int64)  # whole pieces have sequences of their own

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length).tolist():
            own, rows = length == x, self.rows[x]
            row = rows[np.searchsorted(rows[:, 0], number[own], side="right") - 1]
            sequence[own] = row[:, 1] + number[own] - row[:, 0]
            offset[own] = row[:, 2]
        return sequence, offset


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of docs(doc_id, text)."""
    spark = docs.sparkSession
    cut_ = written(pieces(docs, vocabulary), "pieces")
    by_task = cut_.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = np.zeros(LENGTH + 1, np.int64)
    for x, n in by_task.groupBy("length").agg(F.sum("n")).collect():  # at most LENGTH rows
        counts[x] = n
    counts[LENGTH] = 0
    share = spark.sparkContext.broadcast(Places(plan(spark, counts)))

    def placed(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for length, number in parts:
            sequence, offset = share.value.of(length.to_numpy(), number.to_numpy())
            yield pd.DataFrame({"sequence_id": sequence, "offset": offset})

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.pandas_udf(placed, "sequence_id long, offset long")
    numbered = cut_.join(offsets, ["length", "task"])
    return numbered.withColumn("at", place("length", F.col("before") + F.col("number"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir, "doc_id", "text"))
