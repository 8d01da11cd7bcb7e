"""Near-duplicate removal of the pipeline: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Texts whose SimHashes (64 bits, as `op10_simhash` has them) the BK-trees of `simhash` link within three bits are paired first (`tree_pairs`); their whole
sets decide. That finds only some of the pairs at this similarity, so the rest follows exactly, from the sets themselves:

Words are as in `simhash`. A text's set holds the 64-bit hashes of its five-word shingles; a shorter text is one shingle.
Two sets as similar as that share one of the first fifth of their hashes, in whatever order all texts follow (the prefix filter), so every
set is sent to each of those, its keys. The order is that of the hashes, but shingles that a sample finds in many texts
(`common`, bounded by `SAMPLE`) come last, the most frequent at the end: a passage that a third of all texts carry gathers nobody, and
what sets near copies apart comes before what they share. The choice of the sample changes no result.

With the positions of the key in both sets, the sizes decide which pairs can be similar where they first meet; sets of `LEAST`
shingles and more must also have SimHashes within `RADIUS` of 128 bits (at similarity 0.8 they differ in about 19, with a deviation of 4).
A key of up to `ALL_PAIRS` sets gives all those pairs. In a key of more sets, a set is paired with the `NEAREST` of those before it, so that
a group's pairs grow with its size and not with its square. The sets that this leaves out are in the same component as a rule; where
a key's sets are still in several components after that, all its pairs across components follow in a second pass, without the SimHashes.

An odd sketch of a set flips one of `ODD` bits for each shingle. Two sketches differ in no more bits than the sets in shingles, and in
hardly fewer while those are few against ODD; so pairs whose sketches differ in more than similar sets may are dropped without loss,
in the second pass before they leave their key. Large sets have wider sketches besides, of four bits a shingle, and of `BROAD` bits inside a key. All others are verified by the Jaccard similarity of the whole sets of both texts.
Components are joined over what is left.

Defined cases: null, empty and wordless texts share one set; a null doc_id comes last; repeated rows count as equal texts;
empty tables give no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import discard, partitions, small, text_batches, unused, written
from loomwork.llm.components import stars
from loomwork.llm.simhash import fingerprint, links

WORDS, SEED = 5, 42
ALL_PAIRS, NEAREST, RADIUS, LEAST = 16, 3, 40, 32
ODD, BROAD = 2048, 8192
#: Texts of the sample for the order of shingles, and how many of them make a shingle common.
SAMPLE, COMMON = 10_000, 20
STEP = 256
ROWS_A_BUCKET = 250_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bits of a key for the level of its shingle: two levels for each doubling of what the sample has of it.
LEVELS = 5
_KINDS = "s binary, n int, sim long, fp long, fq long, keys array<long>, odd binary, wide binary"
_KEYED = ("k", "i", "n", "rid", "fp", "fq")


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, below 2**63; never empty."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    w = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in words), np.uint64, len(words))
    size = min(WORDS, len(w))
    h = np.full(max(1, len(w) - WORDS + 1), size, np.uint64)
    for i in range(size):
        h = h * _FACTOR + w[i : i + len(h)]
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return np.unique((h ^ (h >> np.uint64(31))) >> np.uint64(1))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of at least 0.8, in whole numbers."""
    both = len(a) + len(b)
    shared = both - len(np.union1d(a, b))
    return 5 * shared >= 4 * (both - shared)


def n_keys(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def keys_of(own: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first fifth of a set by level and hash; common: sorted shingles, and their levels."""
    shingles, levels = common
    if not len(shingles):
        return own[: n_keys(len(own))] >> np.uint64(LEVELS)
    at = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
    level = np.where(shingles[at] == own, levels[at], np.uint64(0))
    return np.sort(level << np.uint64(63 - LEVELS) | own >> np.uint64(LEVELS))[: n_keys(len(own))]


def odd_sketch(own: np.ndarray, bits: int = ODD) -> bytes:
    """Bits (a power of two), each set if an odd number of the shingles fall on it."""
    at = (own * _MIX[1] >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_sketch(own: np.ndarray) -> bytes:
    """Of a large set, a sketch of at least four bits a shingle; of others nothing."""
    bits = 1 << (4 * len(own) - 1).bit_length()
    return odd_sketch(own, bits) if bits > 4 * ODD else b""


def wide_apart(a: bytes, b: bytes) -> int:
    """In how many bits wide sketches differ, at the width of the narrower one: neighbouring bits are joined by xor."""
    x, y = (np.unpackbits(np.frombuffer(s, np.uint8)) for s in sorted((a, b), key=len))
    while len(y) > len(x):
        y = y[::2] ^ y[1::2]
    return int((x ^ y).sum())


def broad_sketch(wide: bytes) -> bytes | None:
    """A wide sketch at BROAD bits, neighbouring bits joined by xor; null for sets that have none."""
    if not wide:
        return None
    bits = np.unpackbits(np.frombuffer(wide, np.uint8))
    while len(bits) > BROAD:
        bits = bits[::2] ^ bits[1::2]
    return np.packbits(bits).tobytes()


def sketches(of: pa.Array) -> np.ndarray:
    """Odd sketches as rows of words."""
    return np.frombuffer(b"".join(of.to_pylist()), np.uint64).reshape(-1, ODD // 64)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits sketches differ, row by row."""
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), 1 << 14):
        out[at : at + (1 << 14)] = np.bitwise_count(a[at : at + (1 << 14)] ^ b[at : at + (1 << 14)]).sum(1, dtype=np.int64)
    return out


def simhash64(of: np.ndarray, mix: np.uint64) -> int:
    of = of * mix  # the highest bit of a hash is free
    ones = np.zeros(64, np.int64)
    for at in range(0, len(of), 1 << 16):
        part = of[at : at + (1 << 16)] ^ (of[at : at + (1 << 16)] >> np.uint64(32))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(of), bitorder="little").view("<i8")[0])


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)))


def _hash() -> Column:
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")).cast("binary"))).alias("t")


def common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least COMMON of a sample of about SAMPLE distinct texts have, and their levels.

    At most SAMPLE / COMMON times a text's shingles, whatever the input.
    """
    text_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    every = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod("h", F.lit(every)) == 0)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text in zip(batch["h"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = shingle_set(text).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), h))], ["x", "h"])

    found = sample.mapInArrow(sets, "x long, h long").distinct().groupBy("x").count().where(F.col("count") >= COMMON)
    rows = sorted((r.x, r["count"]) for r in found.collect())
    counts = np.array([n for _, n in rows], float)
    return np.array([x for x, _ in rows], np.int64).view(np.uint64), np.minimum(1 + 2 * np.log2(counts / COMMON), (1 << LEVELS) - 1).astype(np.uint64)


def described(docs: DataFrame) -> DataFrame:
    """Of docs: doc_id, hash t of the text, rid (unique once written), and SimHash sim of `simhash`, and identity s, size n, 128 bits fp and fq, keys and odd sketches of the shingle set."""
    text_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(common(docs))

    def describe(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            s, n, sim, fp, fq, keys, odd, wide = [], [], [], [], [], [], [], []
            for text in part.to_pylist():
                own = shingle_set(text)
                s.append(xxhash.xxh3_128_digest(own.tobytes()))
                n.append(len(own))
                sim.append(fingerprint(text))
                fp.append(simhash64(own, _MIX[0]))
                fq.append(simhash64(own, _MIX[1]))
                keys.append(keys_of(own, share.value))
                odd.append(odd_sketch(own))
                wide.append(wide_sketch(own))
            yield pa.StructArray.from_arrays(
                [pa.array(s, pa.binary()), pa.array(n, pa.int32()), pa.array(sim, pa.int64()), pa.array(fp, pa.int64()), pa.array(fq, pa.int64()), _longs(keys), pa.array(odd, pa.binary()), pa.array(wide, pa.binary())],
                ["s", "n", "sim", "fp", "fq", "keys", "odd", "wide"],
            )

    own = F.arrow_udf(describe, _KINDS)("text").alias("own")
    return docs.select("doc_id", _hash(), F.monotonically_increasing_id().alias("rid"), own).select("doc_id", "t", "rid", "own.*")


def possible(i: np.ndarray, n: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles can be similar that first meet at places i and j of their orders: neither has what comes before in the other."""
    least = 4 * (n + m)  # nine times what they must share
    return (9 * np.minimum(n - i, m - j) >= least) & (9 * (n + m - i - j) >= 2 * least)


def _small(k: np.ndarray, i: np.ndarray, n: np.ndarray, rid: np.ndarray, fp: np.ndarray, fq: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the groups of equal k (ordered by k, n) that can be similar where they first meet."""
    at = np.arange(len(k))
    for d in range(1, ALL_PAIRS):
        at = at[at + d < len(k)]
        at = at[k[at + d] == k[at]]
        if not len(at):
            return
        a, b = at, at + d
        can = possible(i[a], n[a], i[b], n[b])
        can &= (n[a] < LEAST) | (np.bitwise_count(fp[a] ^ fp[b]) + np.bitwise_count(fq[a] ^ fq[b]) <= RADIUS)
        yield rid[a[can]], rid[b[can]]


def _across(i: np.ndarray, n: np.ndarray, rid: np.ndarray, odd: np.ndarray, of: np.ndarray, at_broad: np.ndarray, broad: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of one large group (ordered by n): all pairs across components that can be similar, by places, sizes and odd sketches.

    Two sets of so many shingles that ODD bits can't tell them apart are judged by their BROAD bits, rows of `broad` at at_broad, too.
    """
    for at in range(0, len(n), STEP):
        high = min(len(n), at + STEP)
        mine = np.arange(at, high)
        low = int(np.searchsorted(5 * n, 4 * n[at]))  # smaller ones can't be similar
        for a in range(low, high, STEP):
            before = np.arange(a, min(high, a + STEP))
            can = (before[None] < mine[:, None]) & (of[None, before] != of[mine, None]) & possible(i[None, before], n[None, before], i[mine, None], n[mine, None])
            x, y = np.nonzero(can)
            x, y = mine[x], before[y]
            good = 9 * apart(odd[x], odd[y]) <= n[x] + n[y]
            x, y = x[good], y[good]
            both = np.flatnonzero((at_broad[x] >= 0) & (at_broad[y] >= 0))
            good = np.ones(len(x), bool)
            good[both] = 9 * apart(broad[at_broad[x[both]]], broad[at_broad[y[both]]]) <= n[x[both]] + n[y[both]]
            yield rid[y[good]], rid[x[good]]


def _large(i: np.ndarray, n: np.ndarray, rid: np.ndarray, fp: np.ndarray, fq: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of one large group (ordered by n): every set with the nearest of those before it."""
    for at in range(0, len(n), STEP):
        high = min(len(n), at + STEP)
        low = int(np.searchsorted(5 * n, 4 * n[at]))  # smaller ones can't be similar
        mine = np.arange(at, high)
        best = [np.zeros(0, np.int64)] * 3
        for a in range(low, high, 1 << 14):
            before = np.arange(a, min(high, a + (1 << 14)))
            away = np.bitwise_count(fp[mine, None] ^ fp[None, before]).astype(np.int16) + np.bitwise_count(fq[mine, None] ^ fq[None, before])
            can = (before[None] < mine[:, None]) & possible(i[None, before], n[None, before], i[mine, None], n[mine, None])
            can &= (n[None, before] < LEAST) | (away <= RADIUS)
            x, y = np.nonzero(can)
            best = [np.concatenate(p) for p in zip(best, (x, before[y], away[x, y].astype(np.int64)), strict=True)]
            order = np.lexsort((best[2], best[0]))  # the nearest ones so far
            x = best[0][order]
            rank = np.arange(len(x)) - np.searchsorted(x, x)
            best = [p[order[rank < NEAREST]] for p in best]
        yield rid[best[1]], rid[mine[best[0]]]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, i, n, rid, fp, fq) of whole keys -> pairs (a, b) that may be similar, and (k, null) for each large key."""
    parts = [[b[c].to_numpy() for c in _KEYED] for b in batches if b.num_rows]
    if not parts:
        return
    k, i, n, rid, fp, fq = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, starts, sizes = _grouped(k, n, rid)
    k, i, n, rid = k[order], i[order].astype(np.int64), n[order].astype(np.int64), rid[order]
    fp, fq = fp[order].view(np.uint64), fq[order].view(np.uint64)
    few = np.repeat(sizes <= ALL_PAIRS, sizes)
    found = list(_small(*(x[few] for x in (k, i, n, rid, fp, fq))))
    for a, m in zip(starts[sizes > ALL_PAIRS], sizes[sizes > ALL_PAIRS], strict=True):
        found += _large(*(x[a : a + m] for x in (i, n, rid, fp, fq)))
    yield from _distinct(found)
    if not few.all():
        large = k[starts[sizes > ALL_PAIRS]]
        yield pa.RecordBatch.from_arrays([pa.array(large), pa.nulls(len(large), pa.int64())], ["a", "b"])


def _across_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, i, n, rid, odd, broad, of) of whole large keys -> pairs (a, b) across components that may be similar."""
    parts, number, held = [], {}, []  # a set's broad sketch is kept once, however many of its keys meet here
    for b in batches:
        if not b.num_rows:
            continue
        at_broad = np.full(b.num_rows, -1)
        for at in np.flatnonzero(b["broad"].is_valid().to_numpy(zero_copy_only=False)).tolist():
            own = b["rid"][at].as_py()
            if own not in number:
                number[own] = len(held)
                held.append(b["broad"][at].as_py())
            at_broad[at] = number[own]
        parts.append(([*(b[c].to_numpy() for c in ("k", "i", "n", "rid", "of")), at_broad], sketches(b["odd"])))
    if not parts:
        return
    broad = np.frombuffer(b"".join(held), np.uint64).reshape(-1, BROAD // 64)
    k, i, n, rid, of, at_broad = (np.concatenate(x) for x in zip(*(p for p, _ in parts), strict=True))
    odd = np.concatenate([o for _, o in parts])
    order, starts, sizes = _grouped(k, n, rid)
    i, n, rid, of, odd, at_broad = i[order].astype(np.int64), n[order].astype(np.int64), rid[order], of[order], odd[order], at_broad[order]
    found = []
    for a, m in zip(starts, sizes, strict=True):
        if (of[a : a + m] != of[a]).any():
            found += _across(*(x[a : a + m] for x in (i, n, rid, odd, of, at_broad)), broad)
    yield from _distinct(found)


def _grouped(k: np.ndarray, n: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by key, size and set, without keys of one set; where each key's rows start, and how many they are."""
    order = np.argsort(k, kind="stable")
    same = k[order[1:]] == k[order[:-1]]
    order = order[np.append(same, False) | np.append(False, same)]
    order = order[np.lexsort((rid[order], n[order], k[order]))]
    own = k[order]
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    return order, starts, np.diff(np.append(starts, len(own)))


def _distinct(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        u, v = (np.concatenate(x) for x in zip(*found, strict=True))
        u, v = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])


def _buckets(sets: DataFrame, counted: DataFrame) -> int:
    rows = counted.agg(F.sum(F.size("keys"))).first()[0] or 0
    return max(partitions(sets.sparkSession), rows // ROWS_A_BUCKET)


def tree_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets(rid, sim) by SimHash: every set with the first one of its fingerprint, and those with the one that their BK-tree hangs them on.

    Links, not all pairs: at most one for each set, and one for each fingerprint and shard.
    """
    first = written(sets.groupBy("sim").agg(F.min("rid").alias("rid")), "prints")
    same = sets.select("sim", F.col("rid").alias("b")).join(first.withColumnRenamed("rid", "a"), "sim").where("a <> b").select("a", "b")
    hung = links(first.select(F.col("sim").alias("fp")), first.count())
    for side, end in (("a", "u"), ("b", "v")):
        hung = hung.join(first.select(F.col("sim").alias(end), F.col("rid").alias(side)), end)
    return same.unionByName(hung.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def candidates(sets: DataFrame, counted: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of sets(rid, n, fp, fq, keys) that may be similar, and large keys (k, null); counted holds at least their keys."""
    keyed = sets.select("rid", "n", "fp", "fq", F.posexplode("keys").alias("i", "k")).select(*_KEYED)
    return keyed.repartition(_buckets(sets, counted), "k").mapInArrow(_pairs, "a long, b long").distinct()


def across(sets: DataFrame, counted: DataFrame, large: DataFrame, hung: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) in large keys (k) whose sets are in different components of hung(u, v)."""
    # The sketches join once the keys are few: only those of large keys go on.
    keyed = sets.select("rid", "n", F.posexplode("keys").alias("i", "k")).join(small(large), "k", "left_semi")

    def broad(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([broad_sketch(x) for x in part.to_pylist()], pa.binary())

    own = sets.select("rid", "odd", F.arrow_udf(broad, "binary")("wide").alias("broad"))
    owned = keyed.join(hung.select(F.col("u").alias("rid"), "v"), "rid", "left").join(own, "rid")
    owned = owned.select("k", "i", "n", "rid", "odd", "broad", F.coalesce("v", "rid").alias("of"))
    return owned.repartition(_buckets(sets, counted), "k").mapInArrow(_across_pairs, "a long, b long").distinct()


def _sides(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()


def sketched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sketches leave it open that they are similar."""

    def near(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for a, b, n, m, u, v in parts:
            both = n.to_numpy(zero_copy_only=False).astype(np.int64) + m.to_numpy(zero_copy_only=False)
            good = 9 * apart(sketches(a), sketches(b)) <= both
            for i in np.flatnonzero(good).tolist():
                x, y = u[i].as_py(), v[i].as_py()
                good[i] = not x or not y or 9 * wide_apart(x, y) <= both[i]
            yield pa.array(good)

    out, own = pairs, sets.join(small(_sides(pairs)), "rid", "left_semi").select("rid", "odd", "n", "wide")
    for side in ("a", "b"):
        out = out.join(own.select(F.col("rid").alias(side), F.col("odd").alias(f"s{side}"), F.col("n").alias(f"n{side}"), F.col("wide").alias(f"w{side}")), side)
    return out.where(F.arrow_udf(near, "boolean")("sa", "sb", "na", "nb", "wa", "wb")).select("a", "b")


def _similar(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in parts:
        sets: dict[str | None, np.ndarray] = {}
        for text in {*left.to_pylist(), *right.to_pylist()}:
            sets[text] = shingle_set(text)
        yield pa.array([similar(sets[x], sets[y]) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.bool_())


def verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """Links (u, v): the pairs (a, b) whose whole sets are similar. Reads pairs more than once."""
    asked = _sides(pairs).join(firsts.select("first.rid", "first.t"), "rid")
    texts = written(docs.select("text", _hash()).join(small(asked), "t").groupBy("rid").agg(F.first("text").alias("text")), "texts")
    near = pairs
    for side in ("a", "b"):
        near = near.join(texts.select(F.col("rid").alias(side), F.col("text").alias(f"t{side}")), side)
    out = written(near.where(F.arrow_udf(_similar, "boolean")("ta", "tb")).select(F.col("b").alias("u"), F.col("a").alias("v")), "links")
    discard(texts)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: of every component, the row with the smallest doc_id stays."""
    columns = docs.columns
    base = written(described(docs), "described")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t", "rid").alias("first")
    firsts = written(base.select("s", first).groupBy("s").agg(F.min("first").alias("first")), "firsts")
    sets = base.select("rid", "n", "sim", "fp", "fq", "keys", "odd", "wide").join(firsts.select("first.rid"), "rid", "left_semi")
    trees = written(tree_pairs(sets), "trees")
    found = written(candidates(sets, base), "pairs")
    near = written(sketched(trees.unionByName(found.where("b is not null")).distinct(), sets), "near")
    linked = verified(near, docs, firsts)
    hung = stars(linked)
    large = found.where("b is null").select(F.col("a").alias("k"))
    if large.take(1):
        rest = written(sketched(across(sets, base, large, hung), sets), "rest")
        more = verified(rest, docs, firsts)
        if more.take(1):
            hung = stars(hung.unionByName(more))
        discard(rest)
    for table in (trees, found, near, linked):
        discard(table)
    repeated = bool(base.groupBy("doc_id", "t").count().where("count > 1").take(1))
    named = firsts.select("first.rid", "first").join(hung.select(F.col("u").alias("rid"), "v"), "rid", "left")
    least = named.groupBy(F.coalesce("v", "rid").alias("root")).agg(F.min("first").alias("first"))
    kept = written(least.select(F.col("first.doc_id").alias("_id"), F.col("first.t").alias("_t")), "kept")
    for table in (base, firsts, hung):
        discard(table)
    of_text = unused("t", [*columns, "_id", "_t"])
    own = docs.select("*", _hash().alias(of_text))
    stay = own.join(kept, own["doc_id"].eqNullSafe(kept["_id"]) & (own[of_text] == kept["_t"]), "left_semi").select(*(own[c] for c in columns))
    return stay.dropDuplicates(["doc_id", "text"]) if repeated else stay
