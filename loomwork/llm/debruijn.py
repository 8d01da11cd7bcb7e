"""Substring dedup over words by de Bruijn compaction: words of windows of `WINDOW` words that also start earlier are removed.

The edges of the graph are the token k-mers, WINDOW words each, between nodes of WINDOW - 1 words. Edges that may repeat come
from `repeats`, bucketed by their minimizer. In each bucket edges get exact identities from their words, and the earliest
source coordinate (document, start) of each edge is found. A bucket returns three kinds of rows (`GRAPH`): the in- and
out-degree that each node has by the bucket's own repeated edges; runs, edges that follow each other both in a slice and at their
earliest source, named by 128 bits of a digest of all their words, with their nodes; and for every place of a run in a text its coordinates
there and at the source.

Spark joins then compact the graph (`compacted`). Degrees are summed over all buckets; nodes of more than one edge in or out are branching.
They are joined to the runs, which end there and fall into pieces; pieces are joined to the places of their runs. Where one piece ends
and the next begins at a node that does not branch, in the text and at the source alike, both belong to one path: a maximal
nonbranching stretch of a text with one source coordinate. Every path carries a digest of the words at its source, which the words that a
text is about to lose must have (`verified`): a coordinate that led elsewhere is an error and stops the job. (A graph
of all k-mers would not survive the shuffle; only k-mers whose minimizer two texts share, or one text has twice, become edges.)

Words are `[^\\x20\\x09-\\x0D]+`. Defined cases: null is a text without words; texts of fewer than WINDOW words are left alone; of documents
with equal texts the one with the smallest doc_id keeps its words; rows that repeat a doc_id and a text are judged alike; a null
doc_id comes before all others; an emptied document keeps its row; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.llm import repeats as R
from loomwork.llm.common import documents, text_batches, words, written

WINDOW = 20
INNER = 6
EMPTY = hashlib.sha256(b"").hexdigest()


#: node, outs, ins: degrees by one bucket. run, run_low, nodes, sums: what a run consists of. doc to source_start, run, run_low: a place of a run.
GRAPH = "doc long, k long, start long, source_doc long, source_start long, run long, run_low long, nodes array<long>, sums array<long>, node long, outs int, ins int"


#: Longer words are hashed and compared one by one.
LONG = 64
#: Bytes of texts that are cut into words at a time, so that arrays stay small; a longer text is alone.
TOGETHER = 1 << 20
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


class Words:
    """The words of texts that follow each other.

    data: the texts, joined by blanks. start, end: bytes of each word. begin: the first word of each text, one more at the end. hashes: of the words.
    """

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts)
        self._bytes = np.frombuffer(self.data + b" " * 8, np.uint8)
        edge = np.flatnonzero(np.diff(_BLANK[self._bytes], prepend=True))
        self.start, self.end = edge[::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.begin = np.searchsorted(self.start, np.append(0, np.cumsum(sizes)))
        size = self.end - self.start
        self.hashes = R.mixed(size.astype(np.uint64))
        for one, part in self._eights(np.arange(len(size))):
            self.hashes[one] = R.mixed(self.hashes[one] * R._M1 + part)
        for i in np.flatnonzero(size > LONG).tolist():
            self.hashes[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]])

    def _eights(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Step by step eight bytes of each of these words, as one number, with the places in the list of the words that have them."""
        eight = np.ndarray(len(self._bytes) - 7, "<u8", self._bytes, strides=(1,))
        one, begin, left = np.arange(len(at)), self.start[at], (self.end - self.start)[at]
        for done in range(0, LONG, 8):
            if not len(one):
                return
            yield one, eight[begin + done] & _LOW[np.minimum(left, 8)]
            more = left > 8
            one, begin, left = one[more], begin[more], left[more] - 8

    def text(self, a: int, z: int) -> bytes:
        """Words a to z, z left out, with what stands between them."""
        return self.data[self.start[a] : self.end[z - 1]]

    def numbers(self) -> np.ndarray:
        """Equal words have equal numbers, others have not: hashes number them, the words themselves decide."""
        _, first, ids = np.unique(self.hashes, return_index=True, return_inverse=True)
        other = first[ids]
        size = self.end - self.start
        same = (size == size[other]).all()
        same = same and all((a == b).all() for (_, a), (_, b) in zip(self._eights(np.arange(len(ids))), self._eights(other), strict=True))
        if same and all(self.text(i, i + 1) == self.text(o, o + 1) for i, o in ((i, other[i]) for i in np.flatnonzero(size > LONG).tolist())):
            return ids
        number: dict[bytes, int] = {}
        return np.fromiter((number.setdefault(w, len(number)) for w in self.data.split()), np.int64, len(ids))


def in_parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, about TOGETHER bytes at a time."""
    part, held = [], 0
    for text in texts:
        if part and held + len(text) > TOGETHER:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def hashed_words(found: list[bytes]) -> np.ndarray:
    return Words(found).hashes


def window_sums(h: np.ndarray) -> np.ndarray:
    """Running digests over the windows of words with hashes h: the xor of two of them is the digest of the windows between."""
    return np.bitwise_xor.accumulate(np.append(np.uint64(0), R.mixed(R.rolled(h, WINDOW))))


def cut(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return next(cut_together([data]))


def cut_together(texts: list[bytes], again: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The keys of each text, and those of windows that it has twice. The words of many texts are hashed at once, which costs a third of one text after the other."""
    none = np.empty(0, np.uint64)
    for part in in_parts(texts):
        w = Words(part)
        if len(w.hashes) < WINDOW:
            yield from ((none, none) for _ in part)
            continue
        inner = R.rolled(w.hashes, INNER)
        keys = R.least_of(inner, WINDOW - INNER + 1)
        for a, z in pairwise(w.begin.tolist()):
            own = keys[a : max(a, z - WINDOW + 1)]
            yield own, _recurring(w.hashes[a:z], inner[a : z - INNER + 1], own) if again and len(own) else none


def _recurring(h: np.ndarray, inner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The keys of windows that recur, in a text of words with hashes h. Their inner strings recur as well, which most texts have none of."""
    inner = np.sort(inner)
    if (inner[1:] != inner[:-1]).all():
        return np.empty(0, np.uint64)
    whole = R.rolled(h, WINDOW)
    order = np.argsort(whole, kind="stable")
    return keys[order[1:][whole[order[1:]] == whole[order[:-1]]]]


def body(data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    found = data.split()
    return [b" ".join(found[s : e + WINDOW - 1]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def edges(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of every slice: its slice, its place there, an identity that equal word sequences share, and its word among all.

    Identities are exact: words are numbered, and a pair of numbers of neighbouring stretches gets a number of its own.
    """
    size = np.diff(w.begin)
    ids = np.append(w.numbers(), np.full(WINDOW, -1))  # so that every stretch has its length

    def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        m = min(len(left), len(right))
        _, both = np.unique((left[:m] + 1) * (int(right.max()) + 2) + right[:m] + 1, return_inverse=True)
        return both.astype(np.int64)

    two = pair(ids, ids[1:])
    four = pair(two, two[2:])
    eight = pair(four, four[4:])
    sixteen = pair(eight, eight[8:])
    twenty = pair(sixteen, four[16:])
    windows = size - WINDOW + 1
    owner = np.repeat(np.arange(len(size)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(np.cumsum(size) - size, windows) + place
    return owner, place, twenty[at], at


def _graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A whole bucket of slices -> rows of GRAPH."""
    bucket = R.Bucket(batches, named=True)
    gone = bucket.gone
    places, runs, nodes = [gone[:, [0, 1, 2, 4, 5, 6, 7]]], [], None
    if bucket.texts:
        own, runs, nodes = _compared(bucket)
        places.append(own)
    places = np.concatenate(places)
    for at in range(0, len(places), 100_000):
        yield _rows(len(part := places[at : at + 100_000]), **{c: pa.array(part[:, i]) for i, c in enumerate(("doc", "k", "start", "source_doc", "source_start", "run", "run_low"))})
    for at in range(0, len(runs), 10_000):
        part = runs[at : at + 10_000]
        longs = pa.list_(pa.int64())
        names = {c: pa.array([r[0][i] for r in part], pa.int64()) for i, c in enumerate(("run", "run_low"))}
        yield _rows(len(part), **names, nodes=pa.array([x for _, x, _ in part], longs), sums=pa.array([x for *_, x in part], longs))
    if nodes is not None:
        for at in range(0, len(nodes[0]), 100_000):
            node, outs, ins = (x[at : at + 100_000] for x in nodes)
            yield _rows(len(node), node=pa.array(node.view(np.int64)), outs=pa.array(outs, pa.int32()), ins=pa.array(ins, pa.int32()))


def _rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"nodes": pa.list_(pa.int64()), "sums": pa.list_(pa.int64()), "outs": pa.int32(), "ins": pa.int32()}
    names = [x.split()[0] for x in GRAPH.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names)


def _compared(b: R.Bucket) -> tuple[np.ndarray, list[tuple], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a bucket's slices: places (doc, k, start, source_doc, source_start, run, run_low), runs (name, nodes, sums), and nodes (node, outs, ins)."""
    w = Words(b.texts)
    owner, place, edge, word = edges(w)
    # Slices are met with the earliest of their places; the others follow it window by window.
    first = b.begin[:-1][owner]
    doc, at = b.doc[first], b.at[first] + place
    order = np.lexsort((at, doc, edge))
    starts, ends = R.runs(edge[order])
    earliest = np.empty(len(order), np.int64)
    earliest[order] = np.repeat(order[starts], ends - starts)
    source_doc, source_at = doc[earliest], at[earliest]
    cuts = np.append(True, (owner[1:] != owner[:-1]) | (source_doc[1:] != source_doc[:-1]) | (source_at[1:] != source_at[:-1] + 1))
    head = np.flatnonzero(cuts)
    tail = np.append(head[1:], len(cuts)) - 1
    node = R.rolled(w.hashes, WINDOW - 1)
    entry, p = b.places_of(owner[head])
    start, sd, sa = b.at[p] + place[head][entry], source_doc[head][entry], source_at[head][entry]
    own = (b.doc[p] != sd) | (start != sa)  # the source itself stays

    # What the runs are: those that some place refers to, and slices of which tasks sent only the earliest. Their names hold all their words.
    sums = window_sums(w.hashes)
    signed, total = node.view(np.int64), sums.view(np.int64)
    names, runs = np.zeros((len(head), 2), np.int64), {}
    for i in np.unique(entry[own]).tolist():
        a, z = int(word[head[i]]), int(word[tail[i]]) + 1
        name = R.run_name(w.text(a, z + WINDOW - 1))  # a slice has single blanks
        names[i] = name
        runs[name] = (name, signed[a : z + 1], total[a : z + 1])
    if len(whole := np.flatnonzero(b.times)):
        windows = np.bincount(owner, minlength=len(b.texts))
        lead = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        for i, a in zip(whole.tolist(), word[lead[whole]].tolist(), strict=True):
            name, z = R.run_name(b.texts[i]), a + int(windows[i])
            runs[name] = (name, signed[a : z + 1], total[a : z + 1])
    places = np.column_stack([b.doc[p], b.k[p], start, sd, sa, names[entry]])[own]

    # Degrees: every distinct edge that occurs twice or more leaves one node and enters another.
    many = np.add.reduceat((np.diff(b.begin) + b.times)[owner][order], starts) > 1
    one = word[order[starts[many]]]
    found, of = np.unique(np.concatenate([node[one], node[one + 1]]), return_inverse=True)
    outs, ins = (np.bincount(x, minlength=len(found)) for x in (of[: len(one)], of[len(one) :]))
    return places, list(runs.values()), (found, outs, ins)


def branching(graph: DataFrame) -> DataFrame:
    """(node) of the nodes that more than one repeated edge leaves, or enters."""
    degrees = graph.where("node is not null").groupBy("node").agg(F.sum("outs").alias("outs"), F.sum("ins").alias("ins"))
    return degrees.where("outs > 1 or ins > 1").select("node")


def pieces(graph: DataFrame) -> DataFrame:
    """(run, run_low, pieces): runs in pieces that end at branching nodes, array<struct<a, z, branches, digest>>, counted from the run's start."""
    runs = graph.where("nodes is not null").select("run", "run_low", "nodes", "sums")
    cuts = runs.select("run", "run_low", F.posexplode("nodes").alias("at", "node")).join(branching(graph), "node", "left_semi")
    cuts = cuts.groupBy("run", "run_low").agg(F.array_sort(F.collect_set("at")).alias("cuts"))  # at most one for each word of a slice
    known = F.coalesce("cuts", F.array().cast("array<int>"))
    bounds = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), known, F.array(F.size("nodes") - 1))))
    out = runs.join(cuts, ["run", "run_low"], "left").select("run", "run_low", "sums", known.alias("cuts"), bounds.alias("bounds"))
    piece = F.transform(
        F.slice("bounds", 1, F.size("bounds") - 1),
        lambda a, i: F.struct(
            a.alias("a"),
            F.get("bounds", i + 1).alias("z"),
            F.array_contains("cuts", a).alias("branches"),
            F.get("sums", F.get("bounds", i + 1)).bitwiseXOR(F.get("sums", a)).alias("digest"),
        ),
    )
    return out.select("run", "run_low", piece.alias("pieces"))


def compacted(graph: DataFrame) -> DataFrame:
    """Paths (doc, k, start, end, source_doc, source_start, digest) of GRAPH rows; starts and ends count windows. Reads graph more than once.

    Written between the joins, so that no aggregate stands in the stage that joins places, and a run of very many places can be split.
    """
    cut_ = written(pieces(graph), "pieces")
    p = F.col("p")
    at = graph.where("doc is not null").join(cut_, ["run", "run_low"]).select("doc", "k", "start", "source_doc", (F.col("start") - F.col("source_start")).alias("line"), F.explode("pieces").alias("p"))
    at = at.select("doc", "k", "source_doc", "line", (F.col("start") + p.a).alias("start"), (F.col("start") + p.z).alias("end"), p.branches.alias("branches"), p.digest.alias("digest"))
    line = Window.partitionBy("doc", "k", "source_doc", "line").orderBy("start", "end")
    again = (F.lag("start").over(line) == F.col("start")) & (F.lag("end").over(line) == F.col("end"))
    at = at.withColumn("again", again).where("again is not true")  # rows that repeat a doc_id and a text send their places twice; twice a digest is none
    fresh = F.col("branches") | F.coalesce(F.lag("end").over(line) != F.col("start"), F.lit(True))
    path = F.count_if("fresh").over(line)
    return (
        at.withColumn("fresh", fresh)
        .withColumn("path", path)
        .groupBy("doc", "k", "source_doc", "line", "path")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bit_xor("digest").alias("digest"))
        .select("doc", "k", "start", "end", "source_doc", (F.col("start") - F.col("line")).alias("source_start"), "digest")
    )


def verified(found: list[bytes], spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The spans (start, end) of windows, ordered by start. All must have the digest of their source."""
    return _verified(window_sums(hashed_words(found)), spans)


def _verified(sums: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    pairs = np.array([(a, z) for a, z, _ in spans], np.int64).reshape(-1, 2)
    own = (sums[np.minimum(pairs[:, 0], len(sums) - 1)] ^ sums[np.minimum(pairs[:, 1], len(sums) - 1)]).view(np.int64)
    odd = (own != np.array([d for *_, d in spans], np.int64)) | (pairs[:, 1] >= len(sums))
    if odd.any():
        raise ValueError(f"windows {pairs[odd][0].tolist()} of {len(sums) - 1} are not those of their source")
    return pairs[np.argsort(pairs[:, 0], kind="stable")]


def _sums_together(texts: list[bytes]) -> Iterator[np.ndarray]:
    """window_sums of each text; all but for one number, which goes in the xor of two."""
    for part in in_parts(texts):
        w = Words(part)
        sums = window_sums(w.hashes)
        yield from (sums[a : max(a + 1, z - WINDOW + 2)] for a, z in pairwise(w.begin.tolist()))


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, rest = [], []
        texts = [x.encode("utf-8", "replace") for x in batch["text"].to_pylist()]
        for text, sums, spans in zip(texts, _sums_together(texts), batch["spans"].to_pylist(), strict=True):
            pairs = _verified(sums, [(s["start"], s["end"], s["digest"]) for s in spans])
            start, end = R.united(pairs[:, 0], pairs[:, 1] + WINDOW - 1)
            found = text.split()
            cuts = [0, *np.column_stack([start, end]).ravel().tolist(), len(found)]
            kept = [w for a, z in zip(cuts[::2], cuts[1::2], strict=True) for w in found[a:z]]
            removed.append(len(found) - len(kept))
            rest.append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays([batch["doc"], batch["t"], pa.array(removed, pa.int64()), pa.array(rest, pa.string())], ["doc", "t", "n_removed", "rest"])


def repeated_spans(docs: DataFrame, first: DataFrame, hot: int = R.HOT) -> DataFrame:
    """The compacted paths of the first copies of texts, with their source coordinates; starts and ends count windows."""
    text_batches(docs.sparkSession)
    return compacted(written(R.slices(R.texts(docs), first, cut, body, again=True, hot=hot, named=True, together=cut_together).mapInArrow(_graph, GRAPH), "graph"))


def first_copies_cut(docs: DataFrame, first: DataFrame, hot: int = R.HOT) -> DataFrame:
    """(doc, t, n_removed, rest) of the first copies that lose words, each once; rest is the kept words with single blanks."""
    spans = R.by_text(repeated_spans(docs, first, hot).groupBy("doc", "k").agg(F.collect_list(F.struct("start", "end", "digest")).alias("spans")), first)
    return R.texts(docs).join(spans, ["doc", "t"]).mapInArrow(_rest, "doc long, t long, n_removed long, rest string")


def op7_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    own = R.texts(docs, "doc_id", F.unhex(R.text_key()).alias("key")).withColumn("w", words(F.col("text")))
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    base = written(
        own.select("doc_id", "doc", "key", "t", n_bytes, F.size("w").cast("long").alias("n_words"), F.unhex(F.sha2(F.array_join("w", " "), 256)).alias("sha")), "texts"
    )
    first = R.first_copies(base)
    done = first_copies_cut(docs, first).select("doc", "t", "n_removed", F.sha2("rest", 256).alias("kept")).distinct()
    copy = (F.col("doc") > F.col("first")) & (F.col("n_words") >= WINDOW)
    return (
        base.join(first.select("key", "first"), "key")
        .join(done, ["doc", "t"], "left")
        .select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"),
        )
    )


OP7_SQL = f"""
with d as (select row_number() over () as r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as w from documents),
k as (select r, doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as s from (select *, unnest(range(1, len(w) - {WINDOW - 2})) as i from d)),
b as (select r, i from k qualify rank() over (partition by s order by doc_id, i) > 1),
c as (select distinct r, unnest(range(i, i + {WINDOW})) as i from b),
u as (select r, w, unnest(range(1, len(w) + 1)) as i from d),
v as (select r, string_agg(w[i], ' ' order by i) as kept, count(*) as n from u anti join c using (r, i) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join v using (r)
"""
