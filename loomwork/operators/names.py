"""Matching of place names: normalised, exact in several spellings, else by shared words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def normalised(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """Lower case, without brackets, only letters and digits with single blanks; then an alias, if the name has one."""
    text = F.regexp_replace(F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit("and")), r"\s*\(.*?\)\s*", " "), "[^a-z0-9]+", " ")
    text = F.trim(text)
    out = F.when(F.lit(False), "")
    for old, new in (aliases or {}).items():
        out = out.when(text == old, new)
    return out.otherwise(text)


def matched(left: DataFrame, right: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """left(name) with `label` of right(key, ord, label): the first exact spelling, else most shared words (two at least, and all but one).

    As all words but one must be shared, one of any two is: names meet by an equi-join on their two rarest words, so a word that very
    many names have makes no pairs. Shared words are then counted on the pairs.
    """
    name = F.col("name")
    spellings = F.array(normalised(name, aliases), normalised(F.substring_index(name, "(", 1), aliases), normalised(F.substring_index(name, "-", 1), aliases))
    named = left.select("name").distinct()
    exact = named.select("name", F.posexplode(spellings).alias("pos", "key")).where("key <> ''").join(right, "key")
    exact = exact.groupBy("name").agg(F.min_by("label", F.struct("pos", "ord")).alias("exact"))
    tokens = lambda c: F.array_distinct(F.split(c, " "))
    mine = named.select("name", tokens(normalised(name, aliases)).alias("t"))
    labelled = right.select("label", "ord", tokens(F.col("key")).alias("o"))
    other = labelled.select("label", "ord", "o", F.explode("o").alias("w")).where("w <> ''")
    often = other.groupBy("w").agg(F.count("*").alias("often"))
    words = mine.select("name", "t", F.explode("t").alias("w")).join(often, "w", "left")
    rare = words.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy(F.coalesce("often", F.lit(0)), "w"))).where("_r <= 2")
    met = rare.select("name", "t", "w").join(other, "w").dropDuplicates(["name", "label", "ord"])
    shared = met.select("name", "label", "ord", F.size("t").alias("n"), F.size(F.filter(F.array_intersect("t", "o"), lambda w: w != "")).alias("score"))
    good = shared.where((F.col("score") >= 2) & (F.col("score") >= F.col("n") - 1))
    best = good.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "ord"))).where("_r = 1")
    fuzzy = best.select("name", F.col("label").alias("fuzzy"))
    return left.join(exact, "name", "left").join(fuzzy, "name", "left").withColumn("label", F.coalesce("exact", "fuzzy")).drop("exact", "fuzzy")
