"""SimHash near-duplicates, linked through BK-trees.

A text's fingerprint: ASCII capitals are lowered, words are `[^\\x20\\x09-\\x0D]+`, three-word shingles (repeats included; a shorter
text is one shingle) are hashed by XXH64 with seed 42, and a bit is set if it is set in over half the hashes.

Fingerprints within `RADIUS` bits are linked. Of five blocks of bits, two fingerprints that differ in at most three
bits agree on at least two; so each distinct fingerprint is sent, once for each pair of blocks, to the shard of those bits. Every shard
builds a BK-tree, whose children are keyed by their Hamming distance to the parent, and sends its own fingerprints
down the edges within the radius. A shard returns one link for each linked fingerprint, not its pairs: within a
tree, queries and subtrees that already hang together are not compared again. Trees stay with their shard instead of being
broadcast, as their number and size grow with the data. Components are then joined over all shards.

Defined cases: null, empty and wordless texts have fingerprint zero and are linked like any other; repeated rows each get their
row; a null doc_id never names a component unless it has only such rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import documents, partitions, text_batches, written
from loomwork.llm.components import stars

RADIUS = 3
BLOCKS = 5
WORDS, SEED = 3, 42
STEP = 1 << 16
ROWS_A_TASK = 2_000_000


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(words) - WORDS + 1)
    for at in range(0, n, STEP):
        part = words[at : at + STEP + WORDS - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(WORDS)), strict=False)) if len(part) >= WORDS else [b" ".join(part)]
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([fingerprint(t) for t in part], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of docs(doc_id, text)."""
    text_batches(docs.sparkSession)
    return docs.select("doc_id", F.pandas_udf(_fingerprints, "long")("text").alias("fp"))


class Forest:
    """Union-find over 0..n-1; roots are the least of their tree."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, of: np.ndarray) -> np.ndarray:
        found = self.up[of]
        while (found != (higher := self.up[found])).any():
            found = higher
        self.up[of] = found
        return found

    def unite(self, of: np.ndarray) -> None:
        roots = np.unique(self.roots(of))
        self.up[roots] = roots[0]


def tree_links(prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the distinct prints, the least index that it reaches over links within the radius.

    The BK-tree over prints is built as it is searched: the first member of a subtree is its root, and the
    others fall into children by their distance to it. Queries follow the children within the radius.
    """
    forest = Forest(len(prints))
    everything = np.arange(len(prints))
    todo = [(everything, everything)]
    while todo:
        members, queries = todo.pop()
        root, rest = members[0], members[1:]
        away = np.bitwise_count(prints[queries] ^ prints[root]).astype(np.int16)
        if len(near := queries[away <= radius]):
            forest.unite(np.append(near, root))
        if not len(rest):
            continue
        own = forest.roots(rest)
        if (own == own[0]).all():  # one component: only the queries outside it can still link
            open_ = forest.roots(queries) != own[0]
            queries, away = queries[open_], away[open_]
            if not len(queries):
                continue
        key = np.bitwise_count(prints[rest] ^ prints[root]).astype(np.int16)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for child in np.split(rest[order], cuts):
            d = np.bitwise_count(prints[child[0]] ^ prints[root]).astype(np.int16)
            if len(q := queries[np.abs(away - d) <= radius]):
                todo.append((child, q))
    return forest.roots(everything)


def _masks() -> list[int]:
    cuts = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    block = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    masks = [sum(c) for c in itertools.combinations(block, BLOCKS - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, key, fp) of whole shards -> links (u, v), v the least fingerprint of u's component in the shard."""
    parts = [(b["c"].to_numpy(), b["key"].to_numpy(), b["fp"].to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    c, key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((fp, key, c))
    c, key, fp = c[order], key[order], fp[order]
    starts = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (key[1:] != key[:-1])))
    ends = np.append(starts[1:], len(fp))
    for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
        own = fp[a:b]
        least = tree_links(own.view(np.uint64))
        linked = least != np.arange(len(own))
        if linked.any():
            yield pa.RecordBatch.from_arrays([pa.array(own[linked]), pa.array(own[least[linked]])], ["u", "v"])


def links(distinct: DataFrame, most: int) -> DataFrame:
    """Links (u, v) among at most so many distinct fingerprints (fp): enough of those within the radius to join every component.

    Shards are dealt to as many partitions as keep a task's rows near ROWS_A_TASK, however many fingerprints there are.
    """
    n = max(partitions(distinct.sparkSession), most * len(_masks()) // ROWS_A_TASK)
    keys = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for c, m in enumerate(_masks()))))
    sharded = distinct.select("fp", keys.alias("k")).select("k.c", "k.key", "fp").repartition(n, "c", "key")
    return sharded.mapInArrow(_shard_links, "u long, v long").distinct()


def components(prints: DataFrame) -> DataFrame:
    """prints(doc_id, fp) with component_id, the smallest doc_id that links reach. Reads prints more than once."""
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    hung = stars(links(first.select("fp"), prints.count()))
    grouped = hung.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(
        hung.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct()
    )
    least = grouped.join(first, "fp").groupBy("root").agg(F.min("first").alias("least"))
    linked = grouped.join(least, "root").select("fp", "least")
    # Written, so that the last join has no aggregate in its stage and a fingerprint of very many rows can be split.
    named = written(first.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "named")
    return prints.join(named, "fp")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(fingerprints(documents(spark, sf_dir, "doc_id", "text")), "prints")
    return components(prints).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: this module's links, held against whole sets, and all others of that similarity: see `neardup`."""
    from loomwork.llm import neardup  # it builds on this module

    return neardup.one_of_each(docs)
