"""Fuzzy search over scheme names: token hits, phrases, numbers, and a band below the best score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions.numbers import js_round
from loomwork.session import checkpointed

# Words that queries don't count, and words that name no activity.
STOP_WORDS = ["and", "or", "the", "a", "an", "of", "for", "to", "in", "on", "with"]
FILLER = ["scheme", "samajik", "nyay", "yojana", "loan"]
LEAST_SCORE, BAND, SHOWN = 60, 25, 5
#: Characters of a posting.
GRAM = 3


def query_tokens(q: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(q)), r"\s+"), lambda t: (t != "") & ~t.isin(STOP_WORDS))


def search_score(tokens: Column, name: Column, blob: Column) -> Column:
    """How well a lower-cased name, and all text of a row, meet the tokens of a query; 0 for rows that are out."""
    return _score(tokens, name, F.size(F.filter(tokens, lambda t: blob.contains(t))))


def _score(tokens: Column, name: Column, in_blob: Column) -> Column:
    """The score with so many tokens in all text of a row."""
    n = F.size(tokens)
    phrase = F.array_join(tokens, " ")
    number = F.get(F.filter(tokens, lambda t: t.rlike("^[0-9]{1,3}$")), F.lit(0))
    in_name = F.size(F.filter(tokens, lambda t: name.contains(t)))
    compact = F.regexp_replace(F.regexp_replace(name, r"\b(?:men|women|male|female)\b", " "), r"\s+", " ")
    acting = F.filter(tokens, lambda t: ~t.rlike("^[0-9]+$") & ~t.isin(FILLER))
    acted = F.size(F.filter(acting, lambda t: name.contains(t)))
    titled = F.regexp_extract_all(name, F.lit(r"scheme\s*0*([1-9][0-9]*|0)\b"), F.lit(1))
    out = (
        F.when(name.contains(phrase), 100).otherwise(0)
        + F.when(compact.contains(phrase), 90).otherwise(0)
        + js_round(in_name / n * 50)
        + js_round(in_blob / n * 8)
        + F.when(number.isNotNull() & F.array_contains(titled, number.try_cast("int").cast("string")), 30).otherwise(0)
        + F.when(F.size(acting) == 0, 0).when(acted == F.size(acting), 45).when(acted == 0, -40).otherwise(acted * 8)
        - F.when(in_name / n < 0.6, 50).otherwise(0)
    )
    off = (number.isNotNull() & ~name.contains(number)) | ((in_name < F.least(F.lit(2), n)) & (in_blob < n))
    return F.when(F.coalesce(off, F.lit(False)), 0).otherwise(out).cast("long")


def grams(text: Column) -> Column:
    """All strings of one to `GRAM` characters inside a text, each once."""

    def of_length(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, found).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of_length, range(1, GRAM + 1))))


def candidates(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, id) of all rows that can score: postings of character grams make containment inside words an equi-join.

    asked(query_id, tokens), rows(id, name, blob). A token is inside a text only if all its grams are; it meets the postings of its rarest one. A row
    scores only with two tokens of a query, or with its one; so the token whose rarest gram most rows have may be left out where a
    query has others and says it once: a row that has only this one is out anyway.
    """
    postings = rows.select("id", F.explode(grams(F.concat_ws("\n", F.lower("name"), F.lower("blob")))).alias("gram"))
    frequent = postings.groupBy("gram").agg(F.count("*").alias("rows"))
    said = asked.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    of_token = said.select("token").distinct().select("token", F.explode(F.when(F.length("token") > GRAM, F.filter(grams(F.col("token")), lambda g: F.length(g) == GRAM)).otherwise(F.array("token"))).alias("gram"))
    rarest = of_token.join(frequent, "gram", "left").groupBy("token").agg(F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "gram")).alias("least"))
    known = said.join(rarest.select("token", "least.rows", "least.gram"), "token")
    own = Window.partitionBy("query_id")
    known = known.withColumns({"place": F.row_number().over(own.orderBy(F.desc("rows"), "token")), "n": F.count("*").over(own)})
    used = known.where((F.col("place") > 1) | (F.col("n") == 1) | (F.col("times") > 1)).where("rows > 0")
    return used.select("query_id", "token", "gram").join(postings, "gram").select("query_id", "id").distinct()


def search(queries: DataFrame, schemes: DataFrame) -> DataFrame:
    """queries(query_id, q) x schemes(id, name, blob): up to five rows of a query within 25 points of its best; every row that may be one is scored exactly.

    Queries of equal tokens and schemes of equal name and text are judged once. A row without two tokens of a query (or its only one) in its name has at most 58 points, so names
    alone make candidates. All text adds 0 to 8 points to what the name gives: names whose rows stay below SHOWN others even with all 8 go, then texts decide.
    """
    asked = queries.withColumn("tokens", query_tokens(F.col("q"))).where(F.size("tokens") > 0)
    own = Window.partitionBy("name", "blob").orderBy("id")
    first = schemes.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= SHOWN)
    texts = checkpointed(first.groupBy("name", "blob").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    names = checkpointed(texts.groupBy("name").agg(F.sum(F.size("ids")).alias("rows")))
    said = asked.groupBy("tokens").agg(F.min("query_id").alias("said"))
    said = checkpointed(said)
    some = said.select(F.col("said").alias("query_id"), "tokens")
    met = candidates(some, names.select(F.col("name").alias("id"), "name", F.lit("").alias("blob"))).withColumnRenamed("id", "name")
    scored = met.join(names, "name").join(some, "query_id")
    scored = scored.withColumn("most", _score(F.col("tokens"), F.lower("name"), F.size("tokens"))).where(F.col("most") >= LEAST_SCORE)
    # The names with the most points, until they have SHOWN rows that are sure of what the name gives: no row with less can be shown.
    before = F.sum("rows").over(Window.partitionBy("query_id").orderBy(F.desc("most"), "name").rowsBetween(Window.unboundedPreceding, -1))
    scored = scored.withColumn("before", F.coalesce(before, F.lit(0)))
    least = F.min(F.when(F.col("before") < SHOWN, F.col("most"))).over(Window.partitionBy("query_id")) - 8
    near = scored.withColumn("least", least).where(F.col("most") >= F.col("least")).select("query_id", "tokens", "name", "most")
    blob = F.lower("blob")
    points = js_round(F.size(F.filter("tokens", lambda t: blob.contains(t))) / F.size("tokens") * 8)
    of_text = near.join(texts, "name").withColumn("score", (F.col("most") - 8 + points).cast("long")).where(F.col("score") >= LEAST_SCORE)
    # Each text before one in this order has a row before all of its rows, so the first texts have the first rows; each task keeps SHOWN of a query before the shuffle.
    best = Window.partitionBy("query_id")
    top = of_text.withColumn("_n", F.row_number().over(best.orderBy(F.desc("score"), "name", F.get("ids", F.lit(0))))).where(F.col("_n") <= SHOWN)
    ranked = top.withColumn("id", F.explode("ids")).withColumn("rank", F.row_number().over(best.orderBy(F.desc("score"), "name", "id"))).where(F.col("rank") <= SHOWN)
    kept = ranked.withColumn("best", F.max("score").over(best)).where(F.col("score") >= F.col("best") - BAND)
    shown = kept.select(F.col("query_id").alias("said"), "id", "name", "blob", "score", "rank")
    return asked.join(said, "tokens").drop("tokens").join(shown, "said").drop("said")
