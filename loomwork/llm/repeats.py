"""Where texts share long strings: the Spark jobs that the byte-wise and the word-wise operator have in common.

Every window (50 bytes, or 20 words) has a key: the least hash of the short strings in it, its minimizer. Equal windows have
equal keys, and neighbouring windows mostly share one, so a text has far fewer keys than windows.

1. Keys. Each distinct key of a text goes to the bucket of its hash; a bucket returns the keys that two different texts have.
   Copies of a whole text count as one text. Keys that a bounded sample of texts finds in very many (`common`) need no such
   answer: a text that has one reports it to a bucket of its own number, so no bucket gathers the texts of a common passage.
2. Slices. Every first copy of a text meets its shared keys again. Each run of windows with one shared key is cut out as a slice and
   sent to the bucket of its key. Of equal slices a task sends only the earliest: the others start later than that one, so all
   their windows go, and are told so to the bucket of their document. A common key, or one of more than `HOT` texts, would gather
   their slices in one bucket, so its windows are sent one by one, each to the bucket of its own hash.
3. The operator compares the windows of each bucket exactly and returns runs of windows to remove.

All later copies of a text start in its first copy, so they need none of this; a task sends the keys of equal texts once as long
as it remembers them (`SEEN`). There are spark.sql.shuffle.partitions buckets, and more where they would hold over
`BUCKET_BYTES` of distinct text (up to `MOST_BUCKETS`), so a task holds a bounded share of keys or slices.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.llm.common import partitions, text_batches, written

#: Bytes that a task gathers before it sends them on; slice buckets to a key bucket, so that a task's windows stay small.
FLUSH, FINER = 8 << 20, 4
#: Distinct text to a key bucket; the number of buckets that a shuffle bears.
BUCKET_BYTES, MOST_BUCKETS = 128 << 20, 100_000
#: Texts that a task remembers having sent the keys of.
SEEN = 1 << 17
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SIX = 48
_TWO = struct.Struct("<qq")
#: Texts of a key above which its windows are spread by themselves.
HOT = 50_000
#: Texts of the sample for common keys, and how many of them make a key common.
SAMPLE, COMMON = 10_000, 100
#: Bits of a place that hold its window; above them is the number of the text among those of its document.
PLACE = 32
WINDOWS = (1 << PLACE) - 1
#: Parts in which the texts of one doc_id are numbered; a null doc_id may have very many.
PARTS = 1024


def order_key() -> Column:
    """doc_id as the order of documents; null comes first."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def text_key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return (h ^ (h >> np.uint64(29))) * _M3


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n neighbours in a row, by doubling: each step joins two neighbouring stretches."""
    out, length, at = None, 0, h
    size = 1
    while n:
        if n & 1:
            if out is None:
                out, length = at, size
            else:
                m = min(len(out), len(at) - length)
                if m <= 0:
                    return np.empty(0, np.uint64)
                out = mixed(out[:m] * _M1 + at[length : length + m])
                length += size
        n >>= 1
        if n:
            if len(at) <= size:
                return np.empty(0, np.uint64)
            at = mixed(at[:-size] * _M1 + at[size:])
            size *= 2
    return out


def least_of(h: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    done = 1
    while done * 2 <= n:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    rest = n - done
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal neighbours."""
    starts = np.flatnonzero(np.append(len(keys) > 0, keys[1:] != keys[:-1]))
    return starts, np.append(starts[1:], len(keys)) if len(starts) else starts


def six(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def sent(keys: np.ndarray) -> np.ndarray:
    """48 bits of each key. Least hashes crowd at the low end, so they are mixed anew before they choose buckets."""
    return mixed(keys) >> np.uint64(64 - SIX)


def bucket_of(values: np.ndarray, n: int) -> np.ndarray:
    return ((values >> np.uint64(SIX - 24)) * np.uint64(n) >> np.uint64(24)).astype(np.int32)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones, which ascend."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


#: text -> the key of each window; the keys of windows that occur again in the same text.
Cut = Callable[[bytes], tuple[np.ndarray, np.ndarray]]
#: The same for each text of a list, at once; without the second result if the flag is false.
Together = Callable[[list[bytes], bool], Iterable[tuple[np.ndarray, np.ndarray]]]


def one_by_one(cut: Cut) -> Together:
    return lambda texts, again: map(cut, texts)


KEYS = "bucket int, vals binary, ts binary, counts binary, common boolean"


def common_keys(texts: DataFrame, cut: Cut, together: Together | None = None) -> np.ndarray:
    """Keys, as sent, that at least COMMON of a sample of about SAMPLE distinct texts have: at most SAMPLE / COMMON times a text's keys."""
    text_batches(texts.sparkSession)
    rows = texts.select("text", F.xxhash64("text").alias("h"))
    every = max(1, rows.count() // SAMPLE)
    cuts = together or one_by_one(cut)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = cuts([(x or "").encode("utf-8", "replace") for x in batch["text"].to_pylist()], False)
            for h, (own, _) in zip(batch["h"].to_pylist(), found, strict=True):
                own = np.unique(sent(own)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), h))], ["x", "h"])

    found = rows.where(F.pmod("h", F.lit(every)) == 0).mapInArrow(keys, "x long, h long").distinct().groupBy("x").count()
    return np.sort(np.array([r.x for r in found.where(F.col("count") >= COMMON).collect()], np.uint64))


def _send_keys(cut: Cut, n: int, common: np.ndarray = np.zeros(0, np.uint64), together: Together | None = None) -> Callable:  # noqa: B008
    cuts = together or one_by_one(cut)

    def flush(vals: list, of: list, ts: list, common: bool) -> pa.RecordBatch:
        v, t = np.concatenate(vals), np.repeat(np.arange(len(of)), of)
        # Common keys need no meeting: their texts are dealt by their own number.
        b = bucket_of(sent(np.array(ts, np.int64).view(np.uint64))[t] if common else v, n)
        order = np.argsort(b, kind="stable")
        v, t, b = v[order], t[order], b[order]
        ids = np.array(ts, np.int64)
        cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        rows = []
        for a, z in zip(cuts, np.append(cuts[1:], len(b)), strict=True):
            s, e = runs(t[a:z])
            rows.append((int(b[a]), six(v[a:z]), ids[t[a:z][s]].tobytes(), (e - s).astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays(
            [*(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)), pa.array([common] * len(rows))],
            ["bucket", "vals", "ts", "counts", "common"],
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, many, held = ([], [], []), ([], [], []), 0
        seen: set[int] = set()
        for batch in batches:
            new: dict[int, bytes] = {}
            for t, text in zip(batch["t"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if t in seen:
                    continue
                if len(seen) == SEEN:
                    seen.clear()
                seen.add(t)
                new[t] = (text or "").encode("utf-8", "replace")
            for t, (keys, again) in zip(new, cuts(list(new.values()), True), strict=True):
                if not len(keys):
                    continue
                keys, again = np.unique(sent(keys[runs(keys)[0]])), np.unique(sent(again)) if len(again) else again
                if len(common):
                    known = among(keys, common)
                    keys, usual, again = keys[~known], keys[known], again[~among(again, common)]
                    if len(usual):
                        for to, x in zip(many, (usual, len(usual), t), strict=True):
                            to.append(x)
                        held += len(usual) * 8
                for v, own in ((keys, t), (again, t ^ 1)):
                    # A key of windows that occur twice in one text is sent under a second name too.
                    if len(v):
                        for to, x in zip(rare, (v, len(v), own), strict=True):
                            to.append(x)
                        held += len(v) * 8
            if held > FLUSH:
                yield from (flush(*own, own is many) for own in (rare, many) if own[0])
                rare, many, held = ([], [], []), ([], [], []), 0
        yield from (flush(*own, own is many) for own in (rare, many) if own[0])

    return send


def _shared_keys(hot: int) -> Callable:
    """A whole bucket -> for each text the keys that another text has as well, and those of them that are hot."""
    return lambda batches: _shared(batches, hot)


def _shared(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    vals, ts = [], []
    for batch in batches:
        for v, t, c, common in zip(*(batch[x].to_pylist() for x in ("vals", "ts", "counts", "common")), strict=True):
            if common:  # known to be shared, and hot
                cuts = [0, *(np.cumsum(np.frombuffer(c, "<u4"), dtype=np.int64) * 6).tolist()]
                own = pa.array([v[a:z] for a, z in zip(cuts, cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, np.int64)), own, own], ["t", "vals", "hot"])
                continue
            vals.append(from_six(v))
            ts.append(np.repeat(np.frombuffer(t, np.int64), np.frombuffer(c, "<u4")))
    if not vals:
        return
    v, t = np.concatenate(vals), np.concatenate(ts)
    del vals, ts
    order = np.argsort(v, kind="stable")
    v, t = v[order], t[order]
    starts, ends = runs(v)
    shared = np.repeat(np.minimum.reduceat(t, starts) != np.maximum.reduceat(t, starts), ends - starts)
    many = np.repeat(ends - starts > hot, ends - starts)
    v, t, many = v[shared], t[shared], many[shared]
    order = np.lexsort((v, t))
    v, t, many = v[order], t[order], many[order]
    starts, ends = runs(t)
    for at in range(0, len(starts), 20_000):
        part = range(at, min(at + 20_000, len(starts)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(t[starts[part.start : part.stop]]),
                pa.array([six(np.unique(v[starts[i] : ends[i]])) for i in part], pa.binary()),
                pa.array([six(np.unique(v[starts[i] : ends[i]][many[starts[i] : ends[i]]])) for i in part], pa.binary()),
            ],
            ["t", "vals", "hot"],
        )


class _Slices:
    """What a task has gathered: for each slice its earliest places, and the places that come later."""

    def __init__(self, n: int, again: bool, named: bool):
        self.n, self.again = n, again  # again: a later place in the same document counts as later
        self.named = named  # later places carry the name of their run
        self.found: dict[tuple[int, bytes], list[int]] = {}
        self.later: list[int] = []
        self.held = 0

    def add(self, bucket: int, body: bytes, windows: int, doc: int, place: int) -> None:
        own = self.found.get((bucket, body))
        if own is None:
            self.found[bucket, body] = [0, doc, place]
            self.held += len(body) + 250
            return
        if (doc, place) == (own[1], own[2]):  # a repeated row
            return
        name = run_name(body) if self.named else ()
        # Windows start by document and, if again, by where they start, whichever text of the document it is; equal ones stay.
        mine, its = ((doc, place & WINDOWS), (own[1], own[2] & WINDOWS)) if self.again else (doc, own[1])
        if mine == its:
            own += (doc, place)
        elif mine < its:
            for d, p in zip(own[1::2], own[2::2], strict=True):
                self.later += (d, p, windows, doc, place, *name)
            own[0] += len(own) // 2
            own[1:] = doc, place
        else:
            self.later += (doc, place, windows, own[1], own[2], *name)
            own[0] += 1
        self.held += 130

    def batch(self) -> pa.RecordBatch:
        """One row for each bucket: its slices one after the other with their sizes, their places, and the later places."""
        own: dict[int, list] = {}
        for (bucket, body), places in self.found.items():
            own.setdefault(bucket, []).append((body, places))
        gone: dict[int, bytes] = {}
        if self.later:
            rows = np.array(self.later, np.int64).reshape(-1, 7 if self.named else 5)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            to = bucket_of(mixed(rows[:, 0].astype(np.uint64)) >> np.uint64(64 - SIX), self.n)
            order = np.argsort(to, kind="stable")
            to, rows = to[order], rows[order]
            gone = {int(to[a]): rows[a:z].tobytes() for a, z in zip(*runs(to), strict=True)}
        out = []
        for bucket in sorted({*own, *gone}):
            slices_ = sorted(own.get(bucket, ()))
            sizes = np.array([(len(s), len(w) // 2, w[0]) for s, w in slices_], "<u4")
            places = np.array([x for _, w in slices_ for x in w[1:]], np.int64)
            out.append((bucket, b"".join(s for s, _ in slices_), sizes.tobytes(), places.tobytes(), gone.get(bucket, b"")))
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "bodies", "sizes", "places", "gone"])


def run_name(body: bytes) -> tuple[int, int]:
    """A name for a run of windows: 128 bits of a digest of all that it holds, as two signed numbers."""
    return _TWO.unpack(xxhash.xxh3_128_digest(body))


def _send_slices(cut: Cut, body: Callable[[bytes, np.ndarray, np.ndarray], list[bytes]], n: int, again: bool, named: bool, together: Together | None = None) -> Callable:
    cuts = together or one_by_one(cut)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Slices(n, again, named)
        for batch in batches:
            texts = batch["text"] if "text" in batch.schema.names else batch["rec"].field("text")
            texts = [(x or "").encode("utf-8", "replace") for x in texts.to_pylist()]
            columns = (batch[c].to_pylist() for c in ("doc", "k", "vals", "hot"))
            for data, (keys, _), doc, k, vals, hot in zip(texts, cuts(texts, False), *columns, strict=True):
                starts, ends = runs(keys)
                keys = sent(keys[starts])  # of each run
                mine = among(keys, np.sort(from_six(b"".join(vals))))
                starts, ends, keys = starts[mine], ends[mine], keys[mine]
                many = among(keys, np.sort(from_six(b"".join(hot))))
                if many.any():  # each window by itself, to a bucket of its own
                    single = np.concatenate([np.arange(a, z) for a, z in zip(starts[many], ends[many], strict=True)])
                    for s, at in zip(body(data, single, single + 1), single.tolist(), strict=True):
                        out.add(xxhash.xxh3_64_intdigest(s) % n, s, 1, doc, k << PLACE | at)
                    starts, ends, keys = starts[~many], ends[~many], keys[~many]
                buckets = bucket_of(keys, n).tolist()
                for b, s, at, end in zip(buckets, body(data, starts, ends), starts.tolist(), ends.tolist(), strict=True):
                    out.add(b, s, end - at, doc, k << PLACE | at)
            if out.held > FLUSH:
                yield out.batch()
                out = _Slices(n, again, named)
        if out.found:
            yield out.batch()

    return send


def texts(docs: DataFrame, *more: str | Column) -> DataFrame:
    """(doc, t, text) of docs(doc_id, text): the document's place in order, a number for its text, and the text."""
    return docs.select(*more, order_key().alias("doc"), F.xxhash64(text_key()).alias("t"), F.coalesce("text", F.lit("")).alias("text"))


def first_copies(base: DataFrame) -> DataFrame:
    """base(doc, key, t, n_bytes) -> key, t, n_bytes, first, the smallest document with that text, and k, a number for the text there.

    k is 0 but where rows of one doc_id have several texts; it goes where t, eight random bytes, would be carried along.
    It is the number of a text in its part, by hash, after those of the parts before it, so that the texts of a null doc_id
    meet in no one task. Written, as several joins meet it; and as the join by text then has no aggregate in its stage, very many
    copies can be split.
    """
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int").alias("part")
    first = base.groupBy("key").agg(F.min("doc").alias("first"), F.min("t").alias("t"), F.min("n_bytes").alias("n_bytes")).select("*", part)
    before = Window.partitionBy("first").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = first.groupBy("first", "part").agg(F.count("*").alias("n"))
    offsets = counts.select("first", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("first", "part").orderBy("t", "key"))
    numbered = first.withColumn("rank", rank).join(offsets, ["first", "part"])
    return written(numbered.select("key", "first", "t", "n_bytes", (F.col("offset") + F.col("rank") - 1).alias("k")), "firsts")


def buckets(first: DataFrame) -> int:
    total = first.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    return max(partitions(first.sparkSession), min(MOST_BUCKETS, -(-total // BUCKET_BYTES)))


def slices(texts: DataFrame, first: DataFrame, cut: Cut, body: Callable, again: bool, hot: int = HOT, carried: str = "text", named: bool = False, together: Together | None = None) -> DataFrame:
    """texts(doc, t, text), first(first, t, k, n_bytes) -> packed rows of slices and their places (see `Bucket`), dealt by bucket.

    carried: the column that is shuffled to meet the shared keys, the text or `rec`, a struct with a field text. A later join that
    carries the same columns by doc and t uses the same shuffle.

    again: a later place in the same document counts as later, too. named: places that go whole carry the name of their run.
    together: cut for many texts at once, if that is cheaper than one by one.
    """
    text_batches(texts.sparkSession)
    n = buckets(first)
    keys = texts.select("t", "text").mapInArrow(_send_keys(cut, n, common_keys(texts, cut, together), together), KEYS)
    shared = keys.repartitionById(n, "bucket").mapInArrow(_shared_keys(hot), "t long, vals binary, hot binary")
    wanted = shared.groupBy("t").agg(F.collect_list("vals").alias("vals"), F.collect_list("hot").alias("hot"))
    wanted = first.select(F.col("first").alias("doc"), "t", "k").join(wanted, "t")
    found = texts.select("doc", "t", carried).join(wanted, ["doc", "t"]).mapInArrow(
        _send_slices(cut, body, FINER * n, again, named, together), "bucket int, bodies binary, sizes binary, places binary, gone binary"
    )
    return found.repartitionById(FINER * n, "bucket")


class Bucket:
    """The distinct slices of a bucket, all their places in order, and what goes whole.

    texts: the slices. of, doc, k, at: for each place its slice, document, text number and first window, ascending by slice, document, window and text.
    begin: where the places of each slice begin, one more at the end. times: how many places of each slice went as gone elsewhere.
    gone: rows doc, k, window, number of windows, document and window of an earlier place of the same slice, and two numbers of its name if named.
    """

    def __init__(self, batches: Iterator[pa.RecordBatch], named: bool = False):
        number: dict[bytes, int] = {}
        ids, many, times, places, gone = [], [], [], [], []
        for batch in batches:
            for data, sizes, own, later in zip(*(batch[c].to_pylist() for c in ("bodies", "sizes", "places", "gone")), strict=True):
                size = np.frombuffer(sizes, "<u4").reshape(-1, 3)
                cuts = [0, *np.cumsum(size[:, 0]).tolist()]
                ids += [number.setdefault(data[a:z], len(number)) for a, z in zip(cuts, cuts[1:])]
                many.append(size[:, 1])
                times.append(size[:, 2])
                places.append(own)
                gone.append(later)
        g = np.frombuffer(b"".join(gone), np.int64).reshape(-1, 7 if named else 5)
        self.gone = np.column_stack([g[:, 0], g[:, 1] >> PLACE, g[:, 1] & WINDOWS, g[:, 2], g[:, 3], g[:, 4] & WINDOWS, g[:, 5:]])
        self.texts = list(number)
        self.times = np.bincount(np.array(ids, np.int64), np.concatenate(times) if times else None, len(number)).astype(np.int64)
        of = np.repeat(np.array(ids, np.int64), np.concatenate(many) if many else 0)
        p = np.frombuffer(b"".join(places), np.int64).reshape(-1, 2)
        order = np.lexsort((p[:, 1] >> PLACE, p[:, 1] & WINDOWS, p[:, 0], of))
        self.of, p = of[order], p[order]
        self.doc, self.k, self.at = p[:, 0], p[:, 1] >> PLACE, p[:, 1] & WINDOWS
        self.begin = np.searchsorted(self.of, np.arange(len(self.texts) + 1))

    def places_of(self, slices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a list of slices: an index into the list and one into the places, for every place of every entry."""
        n = self.begin[slices + 1] - self.begin[slices]
        entry = np.repeat(np.arange(len(slices)), n)
        return entry, np.arange(len(entry)) + np.repeat(self.begin[slices] - np.cumsum(n) + n, n)


def spans_by_text(doc: np.ndarray, k: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (doc, k, spans): int64 pairs of start and end, joined where they touch."""
    if not len(doc):
        return
    order = np.lexsort((start, k, doc))
    doc, k, start, end = doc[order], k[order], start[order], end[order]
    begins = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (k[1:] != k[:-1])))
    stops = np.append(begins[1:], len(doc))
    for at in range(0, len(begins), 20_000):
        own = list(zip(begins[at : at + 20_000], stops[at : at + 20_000], strict=True))
        data = [np.stack(united(start[a:z], end[a:z]), 1).astype("<i8").tobytes() for a, z in own]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[[a for a, _ in own]]), pa.array(k[[a for a, _ in own]]), pa.array(data, pa.binary())], ["doc", "k", "spans"]
        )


def by_text(spans: DataFrame, first: DataFrame) -> DataFrame:
    """spans(doc, k, ...) with t for k."""
    return spans.join(first.select(F.col("first").alias("doc"), "k", "t"), ["doc", "k"]).drop("k")


def united(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans that are sorted by start."""
    if len(start) < 2:
        return start, end
    reach = np.maximum.accumulate(end)
    fresh = np.append(True, start[1:] > reach[:-1])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(start) - 1)
    return start[fresh], reach[last]


def joined_spans(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    spans = np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    return united(spans[:, 0], spans[:, 1])
