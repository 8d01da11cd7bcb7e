"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND with every training passage.

A text is cut into cells of as many words as the longest item has; two neighbouring cells are a passage, so every place
where an item can stand lies within a passage. An item's impacts are divided by the item's own score, so a passage that holds all its
words scores 1, and items above `THRESHOLD` are retrieved. Maxima have two levels. Those of whole ranges of items are summed for all
passages of a batch at once: only ranges that could reach the threshold are opened. There WAND moves the posting lists by pivots, and
where the maxima of the lists' blocks at a pivot can't reach the threshold together, all of them skip to the end of the block that ends first.
What is retrieved is verified: at least `OVERLAP` of the item's five-word shingles must stand in the passage, and in order that share
of the words of its question and of its answer (the item's last sentence, or its last third if it has one sentence).

Words are lower-cased runs of letters, digits and marks; ASCII punctuation and blanks separate. The index is built once and broadcast,
in parts of at most `PART_BYTES` of item text, however large the benchmark is; document frequencies, mean length and cells
are those of all items in every part.

Defined cases: null and empty texts and items match nothing; an item of fewer than five words is one shingle; repeated rows
and items are each reported; empty tables give no rows; other columns pass through. Documents are never shuffled.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import documents, table, text_batches, written

THRESHOLD, OVERLAP = 0.6, 0.8
SHINGLE = 5
K1, B = 1.2, 0.75
#: Characters of the texts whose passages a worker sums up at once.
PORTION = 1 << 20
PART_BYTES = 2 << 20
POSTINGS_PER_BLOCK, ITEMS_PER_RANGE, MOST_RANGES = 4, 8, 256
HIT = "array<struct<item_id: long, score: double, overlap: double, question_overlap: double, answer_overlap: double>>"

_SEPARATE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_SEPARATE).split()


def shingles(ids: list[int]) -> list[tuple]:
    return [tuple(ids[i : i + SHINGLE]) for i in range(max(1, len(ids) - SHINGLE + 1))] if ids else []


def answer_start(text: str) -> int:
    """The word with which the answer begins: the last sentence, or the last third of a single one."""
    parts = [n for n in (len(tokens(x)) for x in re.split(r"[.?!\n]+", text)) if n]
    return sum(parts[:-1]) if len(parts) > 1 else math.ceil(2 * sum(parts) / 3)


def in_order(part: list[int], passage: list[int]) -> float:
    """The share of a part's words that the passage has in the same order: their longest common subsequence."""
    if not part:
        return 1.0
    places: dict[int, list[int]] = {}
    for i in range(len(passage) - 1, -1, -1):
        places.setdefault(passage[i], []).append(i)
    ends: list[int] = []  # the least last place of a common subsequence of each length
    for word in part:
        for i in places.get(word, ()):
            at = bisect_left(ends, i)
            ends[at : at + 1] = [i]
    return len(ends) / len(part)


@dataclass(frozen=True)
class Statistics:
    """Of all items: their number, mean length and greatest length in words, and in how many a word occurs."""

    n: int
    mean: float
    longest: int
    df: Mapping[bytes, int]

    @staticmethod
    def of(items: list[list[bytes]]) -> Statistics:
        found = [w for w in items if w]
        return Statistics(len(found), sum(map(len, found)) / max(1, len(found)), max(map(len, found), default=1), Counter(t for w in found for t in set(w)))


class Index:
    """Postings of some items (id, text) in blocks with their maxima, and what verifies a match."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        items = [(i, t, w) for i, t in items if (w := tokens(t or ""))]
        stats = statistics or Statistics.of([w for *_, w in items])
        self.ids = [i for i, *_ in items]
        self.cell = stats.longest
        self.vocab: dict[bytes, int] = {}
        self.seqs = [[self.vocab.setdefault(w, len(self.vocab)) for w in ws] for *_, ws in items]
        self.answers = [answer_start(text) for _, text, _ in items]
        idf = [math.log(1 + (stats.n - stats.df[w] + 0.5) / (stats.df[w] + 0.5)) for w in self.vocab]
        n = len(items)
        self.range = max(ITEMS_PER_RANGE, -(-n // MOST_RANGES))
        #: For each word and range of items, the greatest impact.
        self.most = np.zeros((len(self.vocab), max(1, -(-n // self.range))), np.float32)
        #: For each word: items, impacts, and of every block its last item and its greatest impact.
        self.postings: list[tuple[list[int], list[float], list[int], list[float]]] = [([], [], [], []) for _ in self.vocab]
        for k, seq in enumerate(self.seqs):
            tf = Counter(seq)
            impact = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(seq) / stats.mean)) for t, f in tf.items()}
            whole = sum(impact.values())
            for t, x in impact.items():
                found, values, *_ = self.postings[t]
                found.append(k)
                values.append(x / whole)
                self.most[t, k // self.range] = max(self.most[t, k // self.range], x / whole)
        for found, values, lasts, maxima in self.postings:
            for a in range(0, len(found), POSTINGS_PER_BLOCK):
                lasts.append(found[a : a + POSTINGS_PER_BLOCK][-1])
                maxima.append(max(values[a : a + POSTINGS_PER_BLOCK]))
        #: Pivots that were scored, and that block maxima let skip.
        self.scored = self.skipped = 0

    def wand(self, ranges: range, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All items of some neighbouring ranges that score at least the threshold for these distinct terms, with their scores."""
        low, high, enough, found = ranges.start * self.range, ranges.stop * self.range, threshold - 1e-9, []
        lists = []  # [item, place, end, list maximum, postings]
        for t, most in zip(terms, self.most[terms, ranges.start : ranges.stop].max(1).tolist(), strict=True):
            own = self.postings[t]
            at, end = bisect_left(own[0], low), bisect_left(own[0], high)
            if at < end:
                lists.append([own[0][at], at, end, most, own])
        while lists:
            lists.sort(key=itemgetter(0))
            total, pivot = 0.0, 0
            for pivot, x in enumerate(lists):  # noqa: B007
                total += x[3] * (1 + 1e-6)  # the maxima are rounded
                if total >= enough:
                    break
            else:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            most, until = 0.0, high
            for x in lists[: pivot + 1]:
                lasts, maxima = x[4][2], x[4][3]
                b = bisect_left(lasts, item, x[1] // POSTINGS_PER_BLOCK)
                if b < len(lasts):
                    most += maxima[b]
                    until = min(until, lasts[b])
            if most < enough:  # nothing up to the end of the first of these blocks, or to the next list's item
                self.skipped += 1
                after = until + 1 if pivot + 1 == len(lists) else min(until + 1, lists[pivot + 1][0])
                lists = self._moved(lists, pivot + 1, max(after, item + 1))
            elif lists[0][0] == item:
                self.scored += 1
                score = sum(x[4][1][x[1]] for x in lists[: pivot + 1])
                if score >= enough:
                    found.append((item, score))
                lists = self._moved(lists, pivot + 1, item + 1)
            else:
                lists = self._moved(lists, pivot, item)
        return found

    @staticmethod
    def _moved(lists: list, n: int, to: int) -> list:
        """The first n lists stand at the first item not before `to`; those that end are gone."""
        for x in lists[:n]:
            x[1] = bisect_left(x[4][0], to, x[1], x[2])
            if x[1] < x[2]:
                x[0] = x[4][0][x[1]]
        return [x for x in lists if x[1] < x[2]]

    def verified(self, item: int, passage: list[int]) -> tuple[float, float, float]:
        """What the passage has of an item: shingles, and words of its question and its answer in order."""
        seq, at = self.seqs[item], self.answers[item]
        size = min(SHINGLE, len(seq))
        own, held = set(shingles(seq)), {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)}
        return len(own & held) / len(own), in_order(seq[:at], passage), in_order(seq[at:], passage)

    def hits(self, texts: list[str | None]) -> list[list[dict]]:
        """The verified items of each text, each once with its best passage."""
        out: list[dict[int, dict]] = [{} for _ in texts]
        get = self.vocab.get
        words = [[get(w, -1) for w in tokens(t)] if t else [] for t in texts]
        cells = np.array([-(-len(w) // self.cell) for w in words])
        base = np.cumsum(cells) - cells
        ids = np.array([i for w in words for i in w], np.int64)
        size = np.array([len(w) for w in words])
        place = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        key = ((np.repeat(base, size) + place // self.cell) * (len(self.vocab) + 1) + ids)[ids >= 0]
        key = np.unique(key)
        cell, term = key // (len(self.vocab) + 1), key % (len(self.vocab) + 1)
        n = int(cells.sum())
        if not n or not len(key):
            return [[] for _ in texts]
        sums = np.zeros((n + 1, self.most.shape[1]), np.float32)
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sums[cell[first]] = np.add.reduceat(self.most[term], first, axis=0)
        owner = np.repeat(np.arange(len(texts)), cells)
        pair = np.append(owner[1:] == owner[:-1], False)
        reach = sums[:n] + sums[1:] * pair[:, None]
        begins = np.searchsorted(cell, np.arange(n + 1))
        opened: dict[int, list[range]] = {}
        for c, r in np.argwhere(reach >= THRESHOLD - 1e-4).tolist():
            own = opened.setdefault(c, [])
            if own and own[-1].stop == r:
                own[-1] = range(own[-1].start, r + 1)
            else:
                own.append(range(r, r + 1))
        for c, own in opened.items():
            doc = owner[c]
            last = c + 1 + bool(pair[c])
            terms = sorted(set(term[begins[c] : begins[last]].tolist()))
            at = (c - base[doc]) * self.cell
            passage = words[doc][at : at + 2 * self.cell]
            for item, score in (x for ranges in own for x in self.wand(ranges, terms)):
                overlap, q, a = self.verified(item, passage)
                if min(overlap, q, a) >= OVERLAP and score > out[doc].get(item, {"score": 0})["score"]:
                    out[doc][item] = {"item_id": self.ids[item], "score": float(score), "overlap": overlap, "question_overlap": q, "answer_overlap": a}
        return [list(x.values()) for x in out]


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the items (item_id, text) in parts of at most about PART_BYTES, one after the other, with the statistics of all."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // PART_BYTES))
    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("part"))
    whole = _statistics(rows) if n > 1 else None
    for k in range(n):
        items = sorted((r.item_id, r.text) for r in rows.where(F.col("part") == k).collect())
        yield Index(items, whole(k) if whole else None)


def _statistics(rows: DataFrame) -> Callable[[int], Statistics]:
    """rows(text, part) -> part -> the statistics of all items, as far as that part's words go."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, tokens(t)) for p, t in zip(batch["part"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            each = [(p, len(w), w_) for p, w in found if w for w_ in set(w)]
            items = [(None, len(w), None) for _, w in found if w]
            columns = zip(*each, *items, strict=True) if each else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "length", "word"])

    words = written(rows.mapInArrow(counted, "part long, length long, word binary"), "words")
    n, mean, longest = words.where("word is null").agg(F.count("*"), F.avg("length"), F.max("length")).first()
    df = words.where("word is not null").groupBy("word").agg(F.count("*").alias("df"))

    def of_part(k: int) -> Statistics:
        own = words.where(F.col("part") == k).select("word").distinct()
        return Statistics(n, mean or 0.0, longest or 1, {bytes(r.word): r.df for r in df.join(own, "word").collect()})

    return of_part


def portions(texts: list[str | None], most: int = PORTION) -> Iterator[list[str | None]]:
    """The texts in order, in lists of at most so many characters, or of one text: the sums of a list's passages are held at once."""
    some, held = [], 0
    for t in texts:
        if some and held + len(t or "") > most:
            yield some
            some, held = [], 0
        some.append(t)
        held += len(t or "")
    if some:
        yield some


def hits(docs: DataFrame, index: Index) -> Column:
    """A column of the verified hits of docs' text in an index."""
    text_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(index)

    def search(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts, out = [t if isinstance(t, str) else None for t in part], []
            for some in portions(texts):
                out += share.value.hits(some)
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(search, HIT)("text")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap) of every verified hit."""
    out = None
    for index in indexes(benchmark):
        found = docs.select("doc_id", F.explode(hits(docs, index)).alias("h")).select("doc_id", "h.*")
        out = found if out is None else out.unionByName(found)
    return out


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pipeline's stage: documents with a verified hit go."""
    for index in indexes(benchmark):
        docs = docs.where(F.size(hits(docs, index)) == 0)
    return docs
