"""The first eligible schemes of each profile by lists of offers: equal to scoring every pair, over odd bounds and several stretches of a list."""

import random

from pyspark.sql import functions as F

from loomwork.operators import ranking
from loomwork.plans import matching, shown
from tests.oracles import same_as_sql

SF = "/root/testdata/sf0.001"


def test_recommended_equals_sql(spark):
    same_as_sql(spark, shown, "recommended")


def test_best_equals_scoring_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    profiles = matching._profiles(spark, SF).where("profile_id < 90").withColumn("loan_required", F.when(F.col("profile_id") % 13 == 0, 0.0).otherwise(F.col("loan_required")))
    odd = [(i, rng.choice([None, 0.0, -5.0, 200000.0]), rng.choice([None, 0.0, 1000.0]), rng.choice([None, "Same name", "a"])) for i in range(7)]
    more = spark.createDataFrame(odd, "_n int, most double, least double, other string")
    schemes = matching._schemes(spark, SF).crossJoin(more).withColumn("scheme_id", F.col("scheme_id") * 10 + F.col("_n"))
    schemes = schemes.withColumns({"max_loan": F.coalesce("most", "max_loan"), "min_loan": F.coalesce("least", "min_loan"), "name": F.coalesce("other", "name")}).drop("_n", "most", "least", "other")
    shown_ = ["profile_id", "rank", "scheme_id", "score", "eligibility"]
    every = ranking.recommendations(matching._scored(profiles.crossJoin(schemes)), 4)
    want = sorted(map(tuple, every.select(shown_).collect()))
    for name, value in (("FIRST_OFFERS", 2), ("MORE", 3), ("OFFERS", 4)):
        monkeypatch.setattr(matching, name, value)
    assert sorted(map(tuple, matching.best(profiles, schemes, 4).select(shown_).collect())) == want != []


def test_pairs_follow_the_profiles(spark):
    """No join of profiles with all schemes: doubling the catalogue adds no rows to what a profile meets first."""
    schemes = matching._schemes(spark, SF)
    twice = schemes.unionByName(schemes.withColumn("scheme_id", F.col("scheme_id") + 1000))
    kinds = matching._signs(schemes).select("_sign").distinct().count()
    assert matching._signs(twice).select("_sign").distinct().count() == kinds
    plan = matching.rule_match_rank(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_a_large_catalogue_is_never_broadcast(spark):
    profiles, schemes = matching._profiles(spark, SF), matching._schemes(spark, SF)
    large = matching.Index(dict.fromkeys(matching.BOUNDS, []), matching.BROADCAST_ROWS + 1)
    plan = lambda **how: matching._candidates(profiles, schemes, index=large, **how)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan() and "Broadcast" not in plan()
    assert "BuildLeft" in plan(few=True) and "BuildRight" not in plan(few=True)
