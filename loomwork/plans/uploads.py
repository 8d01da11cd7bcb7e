"""Queries on uploaded files: listings as PDF files, made from parts by expressions, read back and extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import extract
from loomwork.plans import extraction
from loomwork.session import checkpointed
from loomwork.sources import pages


def _content(block: Column, hexed: Column) -> Column:
    """A page's content stream: each line shown, as a literal or a hexadecimal string, and the next line begun."""
    plain = lambda x: F.concat(F.lit("("), F.regexp_replace(x, r"([\\()])", r"\\$1"), F.lit(")"))
    shown = F.transform(F.split(block, "\n"), lambda x: F.concat(F.when(hexed, F.concat(F.lit("<"), F.hex(F.encode(x, "UTF-8")), F.lit(">"))).otherwise(plain(x)), F.lit(" Tj T*")))
    return F.concat(F.lit("BT /F1 11 Tf 14 TL 72 720 Td\n"), F.array_join(shown, "\n"), F.lit("\nET"))


def listing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, length, content): every listing as a PDF file, a page a block; some without a page tree, some cut off."""
    page = F.struct("p_partkey", _content(F.col("block"), F.col("p_partkey") % 3 == 0).alias("content"))
    docs = extraction.blocks(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("p"))
    # Two pages at most: objects 10 and 12 with contents 11 and 13, the second page first in the file.
    body = F.array_join(
        F.reverse(F.transform("p", lambda x, i: F.concat(
            (11 + 2 * i).cast("string"), F.lit(" 0 obj\n<</Length "), F.octet_length(x.content).cast("string"), F.lit(">>\nstream\n"), x.content, F.lit("\nendstream endobj\n"),
            (10 + 2 * i).cast("string"), F.lit(" 0 obj <</Type/Page/Parent 2 0 R/Contents "), (11 + 2 * i).cast("string"), F.lit(" 0 R>> endobj\n"),
        ))), "",
    )
    kids = F.array_join(F.transform("p", lambda x, i: F.concat((10 + 2 * i).cast("string"), F.lit(" 0 R"))), " ")
    tree = F.when((F.col("doc_id") % 13 == 5) & (F.size("p") == 1), F.lit("")).otherwise(F.concat(F.lit("1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/Resources<</Font<</F1 3 0 R>>>>/Kids["), kids, F.lit("]>> endobj\n")))
    whole = F.concat(F.lit("%PDF-1.4\n3 0 obj <</Type/Font/Subtype/Type1/Encoding/WinAnsiEncoding>> endobj\n"), body, tree, F.lit("trailer <</Root 1 0 R>>\n%%EOF\n"))
    content = F.encode(F.when(F.col("doc_id") % 17 == 3, F.substring(whole, 1, 60)).otherwise(whole), "UTF-8")
    return docs.select("doc_id", F.concat(F.lit("/inbox/listing "), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.read_files(listing_files(spark, sf_dir)).withColumn("doc_id", F.regexp_extract("url", r"(\d+)\.pdf$", 1).cast("long"))


def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.size(F.split("raw_text", "\n"))
    return _read(spark, sf_dir).select("doc_id", "url", "kind", "problem", F.when(F.col("raw_text").isNotNull(), lines).alias("n_lines"), F.sha2("raw_text", 256).alias("hash"))


def uploaded_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemes and partners of the uploaded files, as staging rows with their confidence."""
    docs = _read(spark, sf_dir).select("doc_id", F.lit("manual://inbox").alias("url"), F.lit("Listing").alias("title"), F.col("raw_text").alias("text"))
    # Files are parsed once: what is filtered before the checkpoint is parsed for the filter as well.
    docs = checkpointed(docs).where("text is not null")
    schemes, partners = extract.uploaded(docs, ["canonical_key", "interest_rate", "max_loan"], ["canonical_key", "state"])
    found = schemes.select("doc_id", F.lit("scheme").alias("kind"), "canonical_key", "interest_rate", F.round("max_loan", 2).alias("max_loan"), F.lit(None).cast("string").alias("state"), "confidence")
    return found.unionByName(partners.select("doc_id", F.lit("partner").alias("kind"), "canonical_key", F.lit(None).cast("double").alias("interest_rate"), F.lit(None).cast("double").alias("max_loan"), "state", "confidence"))


QUERIES = {f.__name__: f for f in (pdf_text, uploaded_schemes)}

_BLOCKS = f"""b as (select cast(floor(p_partkey / 2) as bigint) as doc_id, p_partkey as k, p_name, p_size,
    array_to_string(list_filter(list_transform(string_split({extraction._TEXTS}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) as t from part)"""

ORACLE_SQL = {
    "pdf_text": f"""with {_BLOCKS}, d as (select doc_id, string_agg(t, chr(10) order by k) as t from b group by doc_id),
      c as (select doc_id, case when doc_id % 17 = 3 then null else t end as t from d)
      select doc_id, 'manual://listing ' || doc_id || '.pdf' as url, 'pdf' as kind, case when t is null then 'unreadable' end as problem,
        len(string_split(t, chr(10))) as n_lines, sha256(t) as hash from c""",
    "uploaded_schemes": f"""with {_BLOCKS}, d as (select * from b where doc_id % 17 <> 3)
      select doc_id, 'scheme' as kind, trim(regexp_replace(lower(p_name || ' Loan Scheme ' || k), '[^a-z0-9]+', '-', 'g'), '-') as canonical_key,
        (4 + k % 9)::double as interest_rate, round((p_size + 0.5)::double * 100000, 2) as max_loan, null as state, 0.7::double as confidence from d
      union all select doc_id, 'partner', 'centre-' || k, null, null, 'S' || p_size, 0.75::double from d""",
}
