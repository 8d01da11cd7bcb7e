"""Suffix-array dedup: bytes of strings of `LENGTH` bytes that also start in an earlier document are removed.

The windows that may repeat (see `repeats`) are the suffixes of each bucket's slices, read up to LENGTH bytes. They are
ordered by deep-shallow sorting: a multikey quicksort, whose characters are eight bytes, orders them to a shallow depth of 16 bytes and
lets go of every suffix that stands alone; groups that still agree there are ordered by blind tries, whose nodes hold only
the places where their suffixes first differ. The leaves of the tries are the strings that agree over LENGTH bytes; the smallest
document that has one keeps it.

Defined cases: null is an empty text; texts shorter than LENGTH bytes are left alone; of documents with equal texts the one
with the smallest doc_id keeps its bytes, and rows that repeat a doc_id are not earlier than each other; a null doc_id comes before
all others; a document all of whose bytes go gets an empty rest; empty tables give no rows; other columns pass through.
Matches never cross documents and are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import repeats as R
from loomwork.llm.common import documents, text_batches, written

LENGTH = 50
INNER = 20
SHALLOW = 2  # characters of eight bytes
EMPTY = hashlib.sha256(b"").hexdigest()


def cut(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    none = np.empty(0, np.uint64)
    if len(data) < LENGTH:
        return none, none
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    return R.least_of(R.rolled(R.mixed(a + np.uint64(1)), INNER), LENGTH - INNER + 1), none


def body(data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [data[s : e + LENGTH - 1] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def characters(buffer: np.ndarray) -> np.ndarray:
    """For each place but the last seven, the eight bytes that begin there as one big-endian number."""
    n = len(buffer) - 7
    out = buffer[:n].astype(np.uint64)
    for i in range(1, 8):
        out = (out << np.uint64(8)) | buffer[i : n + i]
    return out


def multikey(chars: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes (indices of at) that share depth characters with another, and their group; those alone are dropped.

    All groups of a level are partitioned at once: ordered by group, then by the next character.
    """
    order, group = np.arange(len(at), dtype=np.int32), np.zeros(len(at), np.int32)
    for level in range(depth):
        key = chars[at[order] + 8 * level]
        step = np.lexsort((key, group)) if level else np.argsort(key)
        order, group, key = order[step], group[step], key[step]
        fresh = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
        alone = fresh & np.append(fresh[1:], True)
        group = np.cumsum(fresh, dtype=np.int32)[~alone]
        order = order[~alone]
        if not len(order):
            break
    return order, group


def _first_difference(chars: np.ndarray, at: np.ndarray, head: np.ndarray, length: int) -> np.ndarray:
    """The byte at which the strings at `at` first differ from those at `head`; length if they agree that far."""
    out = np.full(len(at), length, np.int16)
    left = np.arange(len(at))
    for c in range(-(-length // 8)):
        x = chars[at[left] + 8 * c] ^ chars[head[left] + 8 * c]
        if length < 8 * (c + 1):
            x &= ~np.uint64(0) << np.uint64(8 * (8 * (c + 1) - length))
        apart = x != 0
        x = x[apart]
        byte = sum((x >> np.uint64(8 * i) == 0).astype(np.int16) for i in range(1, 8))
        out[left[apart]] = 8 * c + byte
        left = left[~apart]
        if not len(left):
            break
    return out


def blind_tries(buffer: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Orders strings of `length` bytes within ascending groups, by one blind trie a group: (order, leaf), strings alone dropped.

    A node of a trie knows only the place where its strings first differ, and branches on the byte there; a node whose strings differ
    nowhere is a leaf, and its strings are equal. All tries grow at once, one level of branches a round.
    """
    chars = characters(buffer)
    order, leaf, keep = np.arange(len(at)), np.zeros(len(at), np.int64), np.ones(len(at), np.bool_)
    slots, node = order.copy(), group
    while len(slots):
        own = order[slots]
        starts, ends = R.runs(node)
        size = ends - starts
        place = np.minimum.reduceat(_first_difference(chars, at[own], np.repeat(at[own[starts]], size), length), starts)
        ended = np.repeat(place == length, size)
        leaf[slots[ended]] = np.repeat(slots[starts], size)[ended]
        slots, own, node = slots[~ended], own[~ended], node[~ended]
        byte = buffer[at[own] + np.repeat(place, size)[~ended]]
        step = np.lexsort((byte, node))
        own, node, byte = own[step], node[step], byte[step]
        order[slots] = own
        fresh = np.append(True, (node[1:] != node[:-1]) | (byte[1:] != byte[:-1]))[: len(node)]
        alone = fresh & np.append(fresh[1:], True)[: len(node)]
        keep[slots[alone]] = False
        leaf[slots[alone]] = slots[alone]
        slots, node = slots[~alone], np.cumsum(fresh)[~alone]
    return order[keep], leaf[keep]


def equal_strings(buffer: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that agree over LENGTH bytes with another, by deep-shallow sorting: (indices of at, in order; group). Eight bytes follow the last."""
    order, group = multikey(characters(buffer), at, SHALLOW)
    if not len(order):
        return order, group
    deep, leaf = blind_tries(buffer, at[order] + 8 * SHALLOW, group, LENGTH - 8 * SHALLOW)
    return order[deep], leaf


def _runs_to_remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A whole bucket of slices -> spans of bytes to remove, by text."""
    bucket = R.Bucket(batches)
    gone = bucket.gone
    rows = [np.column_stack([gone[:, :3], gone[:, 2] + gone[:, 3] + LENGTH - 1])]
    if bucket.texts:
        rows += _compared(bucket)
    yield from R.spans_by_text(*np.concatenate(rows).T)


def _compared(b: R.Bucket) -> list[np.ndarray]:
    """Rows (doc, k, start, end) of bytes to remove, by comparing the windows of all slices of a bucket."""
    buffer = np.frombuffer(b"".join(b.texts) + bytes(8), np.uint8)
    size = np.array([len(x) for x in b.texts])
    base = np.cumsum(size) - size
    windows = size - LENGTH + 1
    owner = np.repeat(np.arange(len(size), dtype=np.int32), windows)
    at = np.arange(len(owner)) + np.repeat(base - np.cumsum(windows) + windows, windows)
    first = b.doc[b.begin[:-1]]  # the smallest document with each slice
    order, label = equal_strings(buffer, at)
    # For every window, the smallest document that has its string.
    least = first[owner]
    if len(order):
        step = np.argsort(label, kind="stable")
        order, label = order[step], label[step]
        starts, ends = R.runs(label)
        least[order] = np.repeat(np.minimum.reduceat(first[owner[order]], starts), ends - starts)
    # In the smallest document: runs of windows whose string starts in a smaller one.
    gone = np.flatnonzero(least < first[owner])
    brk = np.append(len(gone) > 0, (gone[1:] != gone[:-1] + 1) | (owner[gone[1:]] != owner[gone[:-1]]))[: len(gone)]
    s = gone[brk]
    e = gone[np.append(np.flatnonzero(brk)[1:] - 1, len(gone) - 1)] if len(gone) else gone
    entry, place = b.places_of(owner[s].astype(np.int64))
    own = b.doc[place] == first[b.of[place]]
    entry, place = entry[own], place[own]
    start = b.at[place] + (at[s] - base[owner[s]])[entry]
    here = np.column_stack([b.doc[place], b.k[place], start, start + (at[e] - at[s])[entry] + LENGTH])
    # In all other documents: every window, since the smallest one has the whole slice.
    other = b.doc != first[b.of]
    return [here, np.column_stack([b.doc[other], b.k[other], b.at[other], b.at[other] + size[b.of[other]]])]


def without(data: bytes, spans: list[bytes]) -> tuple[bytes, int, int]:
    """What remains, how many bytes go, and in how many runs."""
    start, end = R.joined_spans(spans)
    edges = [0, *np.column_stack([start, end]).ravel().tolist(), len(data)]
    return b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)), int((end - start).sum()), len(start)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True)
        out = [without(text.encode("utf-8", "replace"), spans) for text, spans in texts]
        yield pa.RecordBatch.from_arrays(
            [batch["doc"], batch["t"], pa.array([n for _, n, _ in out], pa.int64()), pa.array([k for *_, k in out], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x, *_ in out], pa.string())],
            ["doc", "t", "n_removed", "n_spans", "kept_sha256"],
        )


def removed_spans(texts: DataFrame, first: DataFrame, hot: int = R.HOT, carried: str = "text") -> DataFrame:
    """(doc, t, spans): for every first copy of a text that loses something, its spans of bytes in packed parts."""
    text_batches(texts.sparkSession)
    found = R.slices(texts, first, cut, body, again=False, hot=hot, carried=carried).mapInArrow(_runs_to_remove, "doc long, k long, spans binary")
    return R.by_text(found.groupBy("doc", "k").agg(F.collect_list("spans").alias("spans")), first)


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    base = written(
        docs.select(
            "doc_id",
            R.order_key().alias("doc"),
            F.unhex(R.text_key()).alias("key"),
            F.xxhash64(R.text_key()).alias("t"),
            F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
            F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"),
        ),
        "texts",
    )
    first = R.first_copies(base)
    texts = R.texts(docs)
    digests = texts.join(removed_spans(texts, first), ["doc", "t"]).mapInArrow(
        _digests, "doc long, t long, n_removed long, n_spans long, kept_sha256 string"
    )
    done = digests.distinct()  # repeated rows
    copy = (F.col("doc") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    lost = F.coalesce("n_removed", F.lit(0))
    return (
        base.join(first.select("key", "first"), "key")
        .join(done, ["doc", "t"], "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(copy, F.col("n_bytes")).otherwise(lost).alias("n_removed"),
            F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        )
    )


def _rests(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, spans in parts:
        out = [
            text if s is None or text is None else without(text.encode("utf-8", "replace"), list(s))[0].decode("utf-8", "ignore")
            for text, s in zip(texts, spans, strict=True)
        ]
        yield pd.Series(out, dtype=object)


def cut_repeats(docs: DataFrame, hot: int = R.HOT) -> DataFrame:
    """The pipeline's stage: texts lose their repeated strings, documents that lose all go; n_chars follows the text.

    A character that a removed string cuts in two goes with it.
    """
    columns = docs.columns
    texts = R.texts(docs, F.struct(*columns).alias("rec"))
    first = R.first_copies(written(texts.select("doc", F.unhex(F.md5("text")).alias("key"), "t", F.octet_length("text").cast("long").alias("n_bytes")), "texts"))
    spans = removed_spans(texts, first, hot, "rec")
    # One small row for each first copy; documents meet it once, and later copies meet none.
    known = first.select(F.col("first").alias("doc"), "t", F.lit(True).alias("kept")).join(spans, ["doc", "t"], "left")
    short = F.octet_length(F.coalesce("rec.text", F.lit(""))) < LENGTH
    out = texts.select("doc", "t", "rec").join(known, ["doc", "t"], "left").where(F.col("kept") | short)
    out = out.withColumn("rest", F.pandas_udf(_rests, "string")("rec.text", "spans")).where(F.col("spans").isNull() | (F.col("rest") != ""))
    new = {"text": F.col("rest"), "n_chars": F.when(F.col("spans").isNull(), F.col("rec.n_chars")).otherwise(F.length("rest"))} if "n_chars" in columns else {"text": F.col("rest")}
    return out.select(*(new.get(c, F.col("rec")[c]).alias(c) for c in columns))


OP6_SQL = f"""
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select r, doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) as s
  from (select *, unnest(range(0, cast(length(h) / 2 as bigint) - {LENGTH - 1})) as i from d)),
m as (select s, min(doc_id) as first from w group by s having count(*) > 1),
b as (select r, i from w join m using (s) where first < doc_id),
g as (select r, i, coalesce(i - lag(i) over (partition by r order by i) > {LENGTH}, true) as fresh from b),
k as (select r, i, sum(fresh::int) over (partition by r order by i) as run from g),
s as (select r, min(i) as a, max(i) + {LENGTH} as z from k group by r, run),
e as (select r, count(*) as n_spans, cast(sum(z - a) as bigint) as n_removed, max(z) as last from s group by r),
p as (select r, lag(z, 1, 0) over (partition by r order by a) as x, a as y from s
  union all select r, last, cast(length(h) / 2 as bigint) from e join d using (r)),
q as (select r, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' order by x) as kept from p join d using (r) group by r)
select doc_id, cast(length(h) / 2 as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join e using (r) left join q using (r)
"""
