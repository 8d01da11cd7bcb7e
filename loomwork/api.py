"""Entry points: what the platform's requests do, each from DataFrames to a DataFrame, for many requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions import dates, numbers
from loomwork.functions.text import purpose_family
from loomwork.operators import duplicates, extract, finance, gate, geo, intent, ranking, rules, search
from loomwork.session import small
from loomwork.sources import schemas

parse_intent = intent.parsed
search_schemes = search.search
with_emi = finance.with_emi
emi_schedule = finance.schedule
extract_schemes = extract.document_schemes


def listed_schemes(schemes: DataFrame) -> DataFrame:
    """Unique live schemes that are loans: the catalogue."""
    figures = F.coalesce("max_loan", "min_loan", "interest_rate", F.col("tenure").cast("double"), "max_income").isNotNull()
    good = gate.is_scheme(F.col("name"), F.col("scheme_type"), F.col("description"), F.col("source_url"), F.col("description"), figures)
    some = (F.coalesce("max_loan", F.lit(0)) != 0) | (F.coalesce("purpose", F.lit("")) != "") | (F.coalesce("scheme_type", F.lit("")) != "")
    return duplicates.newest_schemes(schemes).where(good & some)


def recommend(profiles: DataFrame, schemes: DataFrame, stored_rules: DataFrame, as_of: str, weights: ranking.Weights = ranking.Weights()) -> tuple[DataFrame, DataFrame]:
    """(recommendations, near misses) of every profile: stored and derived rules as rows, scores, ranks, instalments of the top three.

    Candidates come from an equi-join on the purpose family where both sides have one, as a purpose that differs rules a
    scheme out. Only profiles without a recommendation are then held against all schemes, for their near misses.
    """
    good, _ = schemas.accepted(profiles, schemas.profile_problem())
    live = listed_schemes(schemes).withColumnRenamed("id", "scheme_id")
    merged = rules.merged_rules(stored_rules, rules.derived_rules(live))
    candidates = _scored(_candidates(good, live, merged), good, live, merged, as_of, weights)
    best = ranking.recommendations(candidates)
    rest = good.join(candidates.where("eligible").select("profile_id").distinct(), "profile_id", "left_anti").select("profile_id")
    others = _scored(rest.join(small(live.select("scheme_id")), F.lit(True)), good, live, merged, as_of, weights)
    loan = F.coalesce(F.nullif("loan_required", F.lit(0.0)), "max_loan", F.lit(0.0))
    terms = numbers.emi(loan, F.col("interest_rate"), F.coalesce("tenure", F.lit(0)), F.coalesce("moratorium", F.lit(0)), F.lit("monthly"))
    known = F.col("interest_rate").isNotNull() & (F.coalesce("tenure", F.lit(0)) != 0)
    best = best.withColumn("emi_estimate", F.when((F.col("rank") <= 3) & known, terms))
    return best, ranking.near_misses(others)


def _candidates(profiles: DataFrame, schemes: DataFrame, merged: DataFrame) -> DataFrame:
    """(profile_id, scheme_id) that the purpose rules leave open."""
    family = merged.where("rule_type = 'purpose' and operator = 'purpose_match'").select("scheme_id", purpose_family(F.col("str_value")).alias("family"))
    s = schemes.select("scheme_id").join(family, "scheme_id", "left")
    p = profiles.select("profile_id", F.nullif(purpose_family(F.col("purpose")), F.lit("")).alias("own"))
    same = p.join(small(s), F.col("own") == F.col("family"))
    anyone = p.join(small(s.where("family is null")), F.lit(True))
    silent = p.where("own is null").join(small(s.where("family is not null")), F.lit(True))
    return same.unionByName(anyone).unionByName(silent).select("profile_id", "scheme_id")


def _scored(pairs: DataFrame, profiles: DataFrame, schemes: DataFrame, merged: DataFrame, as_of: str, weights: ranking.Weights) -> DataFrame:
    decided = rules.decision(rules.evaluate_rows(pairs, merged, profiles))
    # Pairs without any rule are eligible and half certain.
    free = {"eligible": True, "missing": False, "complete": True, "eligibility": 50.0, "hard_fails": 0, "soft_fails": 0}
    out = pairs.join(decided, ["profile_id", "scheme_id"], "left").fillna(free)
    user = profiles.select("profile_id", *(F.col(c).alias(f"u_{c}") if c in ("purpose", "project_type", "gender", "state", "project_cost") else F.col(c) for c in (
        "purpose", "project_type", "gender", "state", "project_cost", "loan_required")))
    out = out.join(user, "profile_id").join(schemes, "scheme_id")
    meant = purpose_family(F.coalesce(F.nullif("purpose", F.lit("")), "scheme_type", F.lit("")))
    fresh = dates.freshness(F.col("last_verified"), dates.at(as_of))
    score = ranking.total_score(
        F.col("eligibility"),
        ranking.purpose_score((purpose_family(F.col("u_purpose")) == meant) & (meant != ""), F.col("u_project_type"), F.col("activities")),
        ranking.loan_score(F.col("loan_required"), F.col("min_loan"), F.col("max_loan")),
        ranking.cost_score(F.col("u_project_cost"), F.col("loan_percentage")),
        ranking.other_score(F.col("u_state"), fresh, F.col("last_verified"), F.col("u_gender"), F.col("target_gender")),
        weights,
    )
    return out.withColumns({"score": score, "freshness": fresh})


def partner_search(users: DataFrame, partners: DataFrame, mapping: DataFrame, status: DataFrame, scheme_id: int, as_of: str, most_km: int = 100) -> DataFrame:
    """Partners of each user's first ring with a hit, best first; the listing, scored 25, for users without any.

    users(user_id, lat, lon); partners(partner_id, name, latitude, longitude, status, last_verified); status(partner_id, status).
    """
    steps = geo.ladder(most_km)
    ours = geo.mapped_partners(partners, mapping, scheme_id).join(status.select("partner_id", F.col("status").alias("operational")), "partner_id", "left")
    ours = ours.where(geo.allowed(F.col("operational"))).withColumnsRenamed({"latitude": "p_lat", "longitude": "p_lon"})
    hits = geo.nearest_ring(geo.within(users, ours, max(steps)), "user_id", steps)
    active = F.coalesce(F.col("operational") == "active", F.lit(False))
    score = geo.partner_score(F.col("mapped"), F.col("distance_km"), dates.freshness(F.col("last_verified"), dates.at(as_of)), F.col("last_verified"), active)
    near = hits.withColumn("score", score).select("user_id", "partner_id", "name", "distance_km", "matched_radius_km", "score")
    far = users.select("user_id").join(near.select("user_id").distinct(), "user_id", "left_anti")
    none = F.lit(None)
    listed = far.join(ours.select("partner_id", "name"), F.lit(True)).select("user_id", "partner_id", "name", none.cast("double").alias("distance_km"), none.cast("int").alias("matched_radius_km"), F.lit(25.0).alias("score"))
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), F.asc_nulls_last("distance_km"), "name", "partner_id")
    return near.unionByName(listed).withColumn("rank", F.row_number().over(order))
