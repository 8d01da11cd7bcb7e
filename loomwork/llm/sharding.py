"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (here: rows of equal text) are summed first, so a group of any number of copies is one item. Each part of the groups, dealt by
their hash, is packed by itself into bins of a small fixed capacity: largest group first, into the bin with the tightest
remaining room, found in a balanced tree (an AA tree over (room, bin)). These bins, a bounded number whatever the input
(`BINS` times the shards, and one for each part), are then packed into the shards in the same way; the shard
capacity is the least, by bisection, at which best-fit-decreasing needs no more shards than asked for.

The law is `bytes`: shards of near equal size. A group is never split, so a group larger than an even share is a shard's
floor. Slots are numbered without one task seeing a whole shard: rows fall into blocks by a hash of their number in the written
table, so that equal rows spread too, blocks get offsets from their counts, and rows are ranked within blocks.

Defined cases: null and empty texts are one group, of size 1 each; repeated rows and doc_ids each get their own slot; fewer
groups than shards leave shards empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.llm.common import partitions, table, written

BINS = 256
GROUPS_PER_PART = 1_000_000


class RoomTree:
    """An AA tree of (room, bin): insert, remove and the least element at or above, all in logarithmic time."""

    class Node:
        __slots__ = ("key", "left", "level", "right")

        def __init__(self, key):
            self.key, self.level, self.left, self.right = key, 1, None, None

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(n):
        if n and n.left and n.left.level == n.level:
            left = n.left
            n.left, left.right = left.right, n
            return left
        return n

    @staticmethod
    def _split(n):
        if n and n.right and n.right.right and n.level == n.right.right.level:
            right = n.right
            n.right, right.left = right.left, n
            right.level += 1
            return right
        return n

    def insert(self, key) -> None:
        def add(n):
            if n is None:
                return self.Node(key)
            if key < n.key:
                n.left = add(n.left)
            else:
                n.right = add(n.right)
            return self._split(self._skew(n))

        self.root = add(self.root)

    def remove(self, key) -> None:
        def cut(n, key):
            if n is None:
                return None
            if key < n.key:
                n.left = cut(n.left, key)
            elif key > n.key:
                n.right = cut(n.right, key)
            elif n.left is None:
                return n.right
            else:
                best = n.left
                while best.right:
                    best = best.right
                n.key = best.key
                n.left = cut(n.left, best.key)
            least = min(n.left.level if n.left else 0, n.right.level if n.right else 0) + 1
            if least < n.level:
                n.level = least
                if n.right and least < n.right.level:
                    n.right.level = least
            n = self._skew(n)
            n.right = self._skew(n.right)
            if n.right:
                n.right.right = self._skew(n.right.right)
            n = self._split(n)
            n.right = self._split(n.right)
            return n

        self.root = cut(self.root, key)

    def at_least(self, key):
        n, found = self.root, None
        while n:
            if n.key >= key:
                n, found = n.left, n.key
            else:
                n = n.right
        return found


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size; a size above the capacity has a bin to itself."""
    tree, bins, out = RoomTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if found := tree.at_least((sizes[i], -1)):
            tree.remove(found)
            room, out[i] = found
        else:
            room, out[i] = capacity, bins
            bins += 1
        if room > sizes[i]:
            tree.insert((room - sizes[i], out[i]))
    return out


def into_shards(sizes: list[int], shards: int) -> list[int]:
    """Best-fit-decreasing at the least capacity, by bisection, that needs no more than so many shards."""
    low, high = max([0, -(-sum(sizes) // shards), *sizes]), sum(sizes) + 1
    best, step = [0] * len(sizes), low // 512 + 1
    while low < high:
        at = min((low + high) // 2, low + step)
        found = best_fit_decreasing(sizes, at)
        if max(found, default=0) < shards:
            best, high = found, at
            step = max(1, (high - low) // 2)
        else:
            low, step = at + 1, step * 2
        if high - low < max(1, high // 4096):
            break
    return best


def pack(groups: DataFrame, shards: int, total: int, n_groups: int) -> DataFrame:
    """groups(grp long, bytes long) -> (grp, shard)."""
    spark = groups.sparkSession
    unit = max(1, -(-total // (shards * BINS)))
    parts = max(partitions(spark), math.ceil(n_groups / GROUPS_PER_PART))

    def packed(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["bytes", "grp"], ascending=[False, True])
        return pd.DataFrame({"grp": g["grp"], "bytes": g["bytes"], "part": g["part"], "bin": best_fit_decreasing(g["bytes"].tolist(), unit)})

    binned = groups.withColumn("part", F.pmod(F.xxhash64("grp"), F.lit(parts))).groupBy("part").applyInPandas(
        packed, "grp long, bytes long, part long, bin long"
    )
    binned = written(binned, "bins")
    # Bounded: a part opens a bin only when no other has room, so all but one of its bins are half full or more.
    bins = sorted(tuple(r) for r in binned.groupBy("part", "bin").agg(F.sum("bytes").alias("bytes")).collect())
    placed = into_shards([b for *_, b in bins], shards)
    where = spark.createDataFrame([(p, b, s) for (p, b, _), s in zip(bins, placed, strict=True)], "part long, bin long, shard int")
    return binned.join(F.broadcast(where), ["part", "bin"]).select("grp", "shard")


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot."""
    text = F.coalesce("text", F.lit(""))
    rows = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("grp"),
        ),
        "sizes",
    )
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    total, n_groups = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    blocks = max(partitions(docs.sparkSession), n_groups // GROUPS_PER_PART)
    placed = written(
        rows.join(pack(groups, shards, total, n_groups), "grp").withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))),
        "placed",
    ).drop("grp")
    sums = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "block").agg(F.count("*").alias("n")).select(
        "shard", "block", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("offset")
    )  # shards x blocks rows
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32"))
    return placed.withColumn("rank", rank).join(offsets, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).alias("slot")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("grown_shard", F.lit(None).cast("int"))
