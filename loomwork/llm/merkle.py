"""Merkle manifest of a dataset: a leaf for each document, a tree for each language, a tree over their roots, and a proof for each leaf.

H is lowercase hex sha256 of inputs one after the other, digests as hex text. A leaf is H of doc_id, source, lang, n_chars and text, each `-` if null, else its
count of UTF-8 bytes, `:`, and its value. In a tree every two consecutive nodes become their H; a last one that is left alone becomes the H of itself;
what remains is the root, so a lone leaf is its own. The roots of the languages, null first, then by bytes, make the last tree.

Leaves are hashed by Spark expressions and dealt by range of (language, doc_id, leaf); counts of the partitions give each its place (`ranked`). A
block is 2^`BITS` consecutive places of a tree, aligned, so a block's root is a node of the tree. Each block is one group: a postorder recursion (`visit`) returns
the digest of a subtree, and while it unwinds appends each half's digest to the proofs of the leaves in the other half. The roots of the blocks are
nodes of another traversal of the same kind, until each tree has one block: four traversals for 10^12 documents. Then what lies above
is joined to the blocks below it (`manifest`). No group is larger than a block, whatever share of the documents one language holds, and the driver gets no digests.

Places in storage are binary (32 bytes). Every traversal is written, so none runs twice.

Defined cases: rows that share a doc_id come in order of their leaves, and each is a leaf (which of equal rows gets which place is arbitrary); a null
doc_id comes before all others; null lang is a tree of its own, apart from the empty string; a null text and an empty one have different leaves; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.llm.common import documents, partitions, small, text_batches, written

#: Levels of a block: 2^BITS nodes.
BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(**changed: Column) -> Column:
    """Binary digest of a document's row; changed: other values for some of its columns."""
    values = [changed.get(c, F.col(c)).cast("string") for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256))


def tree_key(lang: Column) -> Column:
    """16 bytes for a language, so that tables by language have rows of a known size."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("1"), lang), F.lit("0"))))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows(tree, ...) with pos, a row's place in its tree by these columns, and n, the rows of that tree. No task gathers a tree.

    A last key, the row's number in its partition, spreads equal rows over partitions.
    """
    n = partitions(rows.sparkSession)
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, "tree", *order, "_tie").sortWithinPartitions("tree", *order, "_tie")
    # The id holds the partition and the place in it; written, it stays the same whatever is lost later.
    dealt = written(dealt.drop("_tie").withColumn("_row", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("_row", 33).alias("_part")
    counts = dealt.groupBy("tree", part).agg(F.count("*").alias("rows"), F.min("_row").alias("begin"))  # at most a row for each partition and tree
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "_part", (before - F.col("begin")).alias("shift"), F.sum("rows").over(own).alias("n"))
    placed = dealt.select("*", part).join(small(counts), ["tree", "_part"])
    return placed.select("*", (F.col("_row") + F.col("shift")).alias("pos")).drop("_row", "_part", "shift")


def visit(nodes: list[str], proofs: list[list[str]], at: int, height: int) -> str:
    """Postorder: the digest of the subtree of so many levels whose nodes begin at `at`; proofs get the digests beside their path, lowest first."""
    if not height:
        return nodes[at]
    half = 1 << (height - 1)
    left = visit(nodes, proofs, at, height - 1)
    if at + half >= len(nodes):
        return sha(left)
    right = visit(nodes, proofs, at + half, height - 1)
    for own in proofs[at : at + half]:
        own.append(right)
    for own in proofs[at + half : at + 2 * half]:
        own.append(left)
    return sha(left, right)


def _block(bits: int) -> Callable[[pa.Table], pa.Table]:
    def block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        nodes, n = [x.hex() for x in rows["digest"].to_pylist()], rows["n"][0].as_py()
        proofs: list[list[str]] = [[] for _ in nodes]
        root = visit(nodes, proofs, 0, min(bits, (n - 1).bit_length()))
        rows = rows.append_column("siblings", pa.array([bytes.fromhex("".join(x)) for x in proofs], pa.binary()))
        return rows.append_column("block_root", pa.array([bytes.fromhex(root), *[None] * (len(nodes) - 1)], pa.binary()))

    return block


def traversed(nodes: DataFrame, bits: int) -> DataFrame:
    """nodes(tree, pos, n, digest, ...) with siblings, the digests beside a node's path inside its block, and block_root, at a block's first node."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    block = F.shiftright("pos", bits)
    return written(nodes.groupBy("tree", block).applyInArrow(_block(bits), f"{kinds}, siblings binary, block_root binary"), "merkle-nodes")


def proved(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """leaves(tree, pos, n, digest, ...) with root, and siblings along the whole path to it, lowest first."""
    levels, nodes, most = [], leaves, leaves.agg(F.max("n")).first()[0] or 0
    while most:
        levels.append(traversed(nodes, bits))
        roots = levels[-1].where("block_root is not null")
        # Only trees of several blocks go on.
        nodes = roots.where(F.col("n") > 1 << bits).select("tree", F.shiftright("pos", bits).alias("pos"), F.ceil(F.col("n") / (1 << bits)).alias("n"), F.col("block_root").alias("digest"))
        most = -(-most >> bits) if most > 1 << bits else 0
    if not levels:
        return leaves.select("*", F.col("digest").alias("root"), F.lit(b"").alias("siblings"))
    above = None
    for level in reversed(levels):
        whole = level.where((F.col("block_root").isNotNull()) & (F.col("n") <= 1 << bits))
        known = whole.select("tree", F.lit(0).cast("long").alias("block"), F.lit(b"").alias("more"), F.col("block_root").alias("root"))
        if above is not None:
            known = known.unionByName(above.select("tree", F.col("pos").alias("block"), F.col("siblings").alias("more"), "root"))
        joined = level.drop("block_root").withColumn("block", F.shiftright("pos", bits)).join(known, ["tree", "block"])
        above = joined.withColumn("siblings", F.concat("siblings", "more")).drop("block", "more")
    return above


def manifest(docs: DataFrame, *carried: Column, bits: int = BITS) -> DataFrame:
    """docs(doc_id, source, lang, n_chars, text) -> doc_id, carried, digest (the leaf), pos and n (its place in the language), subroot, lang_pos and langs
    (the language's place), root, and siblings: the digests beside the leaf's path, lowest first, 32 bytes each."""
    rows = written(docs.select("doc_id", "lang", tree_key(F.col("lang")).alias("tree"), leaf().alias("digest"), *carried), "merkle-leaves")
    langs = rows.groupBy("tree").agg(F.min("lang").alias("lang"))
    own = proved(ranked(rows.drop("lang"), "doc_id", "digest"), bits).withColumnRenamed("root", "subroot")
    own = written(own, "merkle-proofs")
    subroots = own.where("pos = 0").select(F.col("tree").alias("of"), "subroot").join(langs.withColumnRenamed("tree", "of"), "of")
    top = ranked(subroots.select(F.lit(b"").alias("tree"), "of", F.col("subroot").alias("digest"), "lang"), "lang")
    top = proved(top, bits).select(F.col("of").alias("tree"), F.col("pos").alias("lang_pos"), F.col("n").alias("langs"), "root", F.col("siblings").alias("more"))
    return own.join(small(written(top, "merkle-top")), "tree").select("*", F.concat("siblings", "more").alias("path")).drop("tree", "siblings", "more").withColumnRenamed("path", "siblings")


def folded(digest: str, siblings: bytes, *places: tuple[int, int]) -> str:
    """The root that a leaf and the siblings of its path make; places: (pos, n) in one tree after the other."""
    used = 0
    for pos, n in places:
        while n > 1:
            if pos ^ 1 < n:
                other, used = siblings[used : used + 32].hex(), used + 32
                digest = sha(other, digest) if pos & 1 else sha(digest, other)
            else:
                digest = sha(digest)
            pos, n = pos >> 1, (n + 1) >> 1
    return digest


def _fold(batches):
    for batch in batches:
        names = ("claim", "siblings", "pos", "n", "lang_pos", "langs")
        out = [bytes.fromhex(folded(d.hex(), s, (p, n), (q, m))) for d, s, p, n, q, m in zip(*(batch[c].to_pylist() for c in names), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "folded_root"])


def checked(proofs: DataFrame) -> DataFrame:
    """A manifest with a column claim, the binary leaf that somebody shows, with folded_root, what it makes of the siblings; it is genuine if that is the root."""
    text_batches(proofs.sparkSession, 5_000)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema)
    return proofs.mapInArrow(_fold, f"{kinds}, folded_root binary")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, *FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claim = F.when(tampered & F.col("n_chars").isNotNull(), leaf(n_chars=F.col("n_chars").cast("decimal(38,0)") + 1)).otherwise(leaf())
    found = checked(manifest(docs, claim.alias("claim")))
    text = lambda c: F.lower(F.hex(c))
    return found.select(
        "doc_id",
        text("digest").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        F.sha2(text("siblings"), 256).alias("proof_sha256"),
        text("folded_root").alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_FIELD = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"


def _sql_leaf(n_chars: str = "n_chars") -> str:
    return "sha256(" + " || ".join(_FIELD.format(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


OP13_SQL = f"""
with recursive
crc as (select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) as t),
d as (select *, list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), cast(4294967295 as bigint)) as h from documents, crc),
l as (select row_number() over () as r, doc_id, lang, {_sql_leaf()} as leaf,
    case when xor(h, 4294967295) % 7 = 0 then {_sql_leaf("(n_chars + 1)")} else {_sql_leaf()} end as claim from d),
p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from l),
nodes(lang, lev, pos, n, d) as (
    select lang, 0, pos, n, leaf from p
    union all
    select lang, lev + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(d, '' order by pos)) from nodes where n > 1 group by lang, lev, pos // 2),
s as (select lang, d as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
top(lev, pos, n, d) as (
    select 0, pos, n, subroot from s
    union all
    select lev + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(d, '' order by pos)) from top where n > 1 group by lev, pos // 2),
steps as (
    select p.r, 0 as tree, a.lev, case when b.d is null then 'N' when a.pos & 1 = 1 then 'L' || b.d else 'R' || b.d end as x
    from p join nodes a on p.lang is not distinct from a.lang and a.n > 1 and a.pos = p.pos >> a.lev
    left join nodes b on b.lang is not distinct from a.lang and b.lev = a.lev and b.pos = xor(a.pos, 1)
    union all
    select p.r, 1, a.lev, case when b.d is null then 'N' when a.pos & 1 = 1 then 'L' || b.d else 'R' || b.d end
    from p join s on p.lang is not distinct from s.lang join top a on a.n > 1 and a.pos = s.pos >> a.lev
    left join top b on b.lev = a.lev and b.pos = xor(a.pos, 1)),
g as (select r, list(x order by tree, lev) as path from steps group by r)
select doc_id, leaf, subroot, top.d as root, sha256(coalesce(list_aggregate(list_transform(path, lambda x: x[2:]), 'string_agg', ''), '')) as proof_sha256,
    list_reduce(coalesce(path, []), lambda a, x: case x[1] when 'L' then sha256(x[2:] || a) when 'R' then sha256(a || x[2:]) else sha256(a) end, claim) as folded_root,
    list_reduce(coalesce(path, []), lambda a, x: case x[1] when 'L' then sha256(x[2:] || a) when 'R' then sha256(a || x[2:]) else sha256(a) end, claim) = top.d as verified
from p join s on p.lang is not distinct from s.lang join top on top.n = 1 left join g using (r)
"""
