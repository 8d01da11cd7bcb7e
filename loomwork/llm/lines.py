"""Line dedup: lines that many documents share go, but from the last document that holds them.

Texts are split at \\n. A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z in lower case. Lines are
exploded as rows (document, text, position, 16 bytes of hash of the key); a key of at least `LEAST_CHARS` code points that `LEAST_DOCS`
documents hold is repeated, and its keeper is the largest of them. Rows of repeated keys in other documents give the positions
that go, and each text is put together again from the lines at the other positions.

Shuffled are, for every line that is long enough, a document and a hash (counted once for each document before they meet, so a
key that a third of all documents hold is many rows of partial counts, not one task); for lines that go, positions; and once, the
texts that lose lines. The join with the repeated keys writes its rows, with no aggregate in its stage, so AQE can split a hot key.

Defined cases: a null or empty text is one empty line, and a null text becomes an empty one; a line that one document holds twice counts once;
rows that repeat a doc_id count as one document, and each loses its lines; a null doc_id is one document, before all others; repeated rows are
judged alike; an emptied document keeps its row; lone surrogates can't occur in a Spark string; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import documents, written
from loomwork.llm.repeats import order_key, text_key

LEAST_CHARS, LEAST_DOCS = 20, 3
ASCII_BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(ASCII_BLANKS))


def line_key(line: Column) -> Column:
    """`lower` where all is ASCII, as it is fast; it would change other letters as well."""
    own = bare(line)
    return F.when(F.octet_length(own) == F.length(own), F.lower(own)).otherwise(F.translate(own, UPPER, LOWER))


def exploded(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc, t, at, h) of every line whose key is long enough: its document, text, position, and the hash of its key."""
    texts = docs.select(order_key().alias("doc"), F.unhex(text_key()).alias("t"), split_lines(F.col("text")).alias("lines"))  # once a text, not a line
    lines = texts.select("doc", "t", F.posexplode("lines").alias("at", "line")).where(F.length(bare(F.col("line"))) >= least_chars)
    return lines.select("doc", "t", "at", F.unhex(F.md5(line_key(F.col("line")))).alias("h"))


def repeated(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(h, n_docs, keeper) of the keys that so many documents hold. Rows meet by key and document first, then as partial counts."""
    counted = lines.groupBy("h").agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("keeper"))
    return counted.where(F.col("n_docs") >= least_docs)


def dropped_positions(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc, t, gone) of the texts that lose lines; gone: their positions, as a set."""
    known = written(repeated(exploded(docs, least_chars), least_docs), "lines-repeated")
    hits = exploded(docs, least_chars).join(known, "h").where(F.col("doc") < F.col("keeper"))
    hits = written(hits.select("doc", "t", "at"), "lines-gone")
    return hits.groupBy("doc", "t").agg(F.collect_set("at").alias("gone"))


def without(text: Column, gone: Column) -> Column:
    """The lines of a text that are not at these positions, joined again."""
    places = F.map_from_arrays(gone, F.transform(gone, lambda _: F.lit(True)))
    return F.array_join(F.filter(split_lines(text), lambda _, i: ~F.coalesce(F.try_element_at(places, i), F.lit(False))), "\n")


def drop_repeated_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc, t, n_dropped, rest) of the texts that lose lines, once each: doc is the doc_id in order, t the md5 of the text, rest the other lines."""
    gone = dropped_positions(docs, least_docs, least_chars)
    texts = docs.select(order_key().alias("doc"), F.unhex(text_key()).alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    cut = texts.join(gone, ["doc", "t"]).select("doc", "t", F.size("gone").cast("long").alias("n_dropped"), without(F.col("text"), F.col("gone")).alias("rest"))
    return cut.dropDuplicates(["doc", "t"])


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    base = docs.select(
        "doc_id",
        order_key().alias("doc"),
        F.unhex(text_key()).alias("t"),
        F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("whole"),
    )
    cut = written(drop_repeated_lines(docs).select("doc", "t", "n_dropped", F.unhex(F.sha2("rest", 256)).alias("cut")), "lines-cut")
    return base.join(cut, ["doc", "t"], "left").select(
        "doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.lower(F.hex(F.coalesce("cut", "whole"))).alias("kept_sha256")
    )


OP11_SQL = f"""
with d as (select row_number() over () as r, coalesce(doc_id, -9223372036854775808) as doc, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
e as (select r, doc, i, l[i] as line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') as k
  from (select *, unnest(range(1, len(l) + 1)) as i from d)),
s as (select k, max(doc) as keeper from e where length(k) >= {LEAST_CHARS} group by k having count(distinct doc) >= {LEAST_DOCS}),
m as (select r, line, i, keeper is not null and doc < keeper as gone from e left join s using (k)),
u as (select r, count(*) as n, count(*) filter (where gone) as g, string_agg(line, chr(10) order by i) filter (where not gone) as kept from m group by r)
select doc_id, cast(n as bigint) as n_lines, cast(g as bigint) as n_dropped, sha256(coalesce(kept, '')) as kept_sha256 from d join u using (r)
"""
