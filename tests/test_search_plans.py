"""Search by postings of grams: equal to SQL and to scoring every pair, without a nested loop."""

import random

from pyspark.sql import functions as F

from loomwork.operators import search
from loomwork.plans import scalars
from tests.oracles import same_as_sql


def test_queries_equal_sql_without_nested_loops(spark):
    same_as_sql(spark, scalars, "fuzzy_search", "search_by_table")
    plan = scalars.search_by_table(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_candidates_lose_no_row_that_scores(spark):
    rng = random.Random(5)
    words = ["scheme", "dairy", "loan", "07", "7", "a1", "women", "mahila", "यो", "poultry", "air"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, name := some(rng.randint(0, 4)), f"{name} {some(2)}" if i % 3 else some(2)) for i in range(60)] + [(60, None, "dairy"), (61, "Dairy Scheme 7", None)]
    asked = [(i, some(rng.randint(0, 4))) for i in range(50)] + [(50, "dairy dairy"), (51, "zzz dairy"), (52, " the "), (53, None)]
    s = spark.createDataFrame(rows, "id int, name string, blob string")
    q = spark.createDataFrame(asked, "query_id int, q string").withColumn("tokens", search.query_tokens(F.col("q")))
    pairs = q.where(F.size("tokens") > 0).crossJoin(s).withColumn("score", search.search_score(F.col("tokens"), F.lower("name"), F.lower("blob")))
    want = {(r.query_id, r.id) for r in pairs.where("score > 0").collect()}
    got = {(r.query_id, r.id) for r in search.candidates(q.where(F.size("tokens") > 0), s).collect()}
    assert want <= got and want and len(got) < pairs.count()
    best = {(r.query_id, r.id): r.score for r in pairs.where("score >= 60").collect()}
    assert all(best[r.query_id, r.id] == r.score for r in search.search(q.select("query_id", "q"), s).collect())


def test_search_equals_scoring_every_pair(spark):
    """Equal names with other texts, equal rows, repeated queries and names of many rows: the rows shown, with their ranks."""
    rng = random.Random(8)
    words = ["scheme", "dairy", "loan", "07", "7", "women", "poultry", "air"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    names = [some(rng.randint(1, 4)) for _ in range(15)] + [None]
    rows = [(i, rng.choice(names), rng.choice([None, "", "dairy", "Loan 7 air", some(3)])) for i in range(150)]
    asked = [(i, some(rng.randint(0, 4))) for i in range(60)] + [(60, "dairy dairy"), (61, " Dairy  LOAN"), (62, "dairy loan"), (63, None)]
    s, q = spark.createDataFrame(rows, "id int, name string, blob string"), spark.createDataFrame(asked, "query_id int, q string")
    pairs = q.withColumn("tokens", search.query_tokens(F.col("q"))).where(F.size("tokens") > 0).crossJoin(s)
    pairs = pairs.withColumn("score", search.search_score(F.col("tokens"), F.lower("name"), F.lower("blob"))).where("score >= 60").collect()
    want = set()
    for i in {r.query_id for r in pairs}:
        mine = sorted((r for r in pairs if r.query_id == i), key=lambda r: (-r.score, r.name, r.id))[: search.SHOWN]
        want |= {(i, r.id, r.score, n) for n, r in enumerate(mine, 1) if r.score >= mine[0].score - search.BAND}
    got = [(r.query_id, r.id, r.score, r["rank"]) for r in search.search(q, s).collect()]
    assert len(got) == len(want) and set(got) == want != set()
