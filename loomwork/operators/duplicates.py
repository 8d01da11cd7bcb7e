"""Newest rows per key, what they retire, and content that hasn't changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions.dates import or_epoch
from loomwork.functions.text import content_hash, entity_key


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def scheme_key() -> list[Column]:
    """Source and stable key of a scheme; a scheme without a key stands for itself."""
    norm = F.coalesce(F.nullif(entity_key(F.col("canonical_key")), F.lit("")), F.concat(F.lit("id-"), F.col("id").cast("string")))
    return [F.coalesce("source_id", F.lit(0)).alias("key_source"), norm.alias("key_norm")]


def newest_schemes(schemes: DataFrame) -> DataFrame:
    """Of active and unavailable schemes, one for each source and stable key: the last verified, then the largest id."""
    live = schemes.where(F.col("status").isin("active", "unavailable")).select("*", *scheme_key())
    order = [or_epoch(F.col("last_verified")).desc(), F.col("id").desc()]
    return latest(live, ["key_source", "key_norm"], order).drop("key_source", "key_norm")


def retired(schemes: DataFrame) -> DataFrame:
    """ids of live schemes that a newer one of the same key replaces."""
    live = schemes.where(F.col("status").isin("active", "unavailable"))
    return live.join(newest_schemes(schemes).select("id"), "id", "left_anti").select("id")


def changed_pages(pages: DataFrame, last: DataFrame, forced: bool = False) -> DataFrame:
    """Pages (source_id, url, raw_text, http_etag) that are new or differ from the last seen (etag, content_hash).

    Texts below 40 characters never count. An equal etag skips a page, then an equal content hash.
    """
    pages = pages.withColumn("content_hash", content_hash(F.col("raw_text"))).where(F.length("raw_text") >= 40)
    if forced:
        return pages
    seen = latest(last, ["source_id", "url"], [F.col("id").desc()]).select(
        "source_id", "url", F.col("content_hash").alias("_hash"), F.col("http_etag").alias("_etag")
    )
    same = (F.col("http_etag") == F.col("_etag")) | (F.col("content_hash") == F.col("_hash"))
    return pages.join(seen, ["source_id", "url"], "left").where(~F.coalesce(same, F.lit(False))).drop("_hash", "_etag")
