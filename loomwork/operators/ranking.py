"""Scores of profile-scheme pairs and what is shown of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Weights:
    # The default weights.
    eligibility: float = 40.0
    purpose: float = 25.0
    loan_amount: float = 15.0
    project_cost: float = 10.0
    other: float = 10.0


def active_weights(rows: DataFrame | None) -> Weights:
    """The first active row by id, else the defaults."""
    row = rows.where("is_active").orderBy("id").first() if rows is not None else None
    return Weights(*(float(row[n]) for n in Weights.__dataclass_fields__)) if row else Weights()


def purpose_score(compatible: Column, project: Column, activities: Column) -> Column:
    """100 for a compatible purpose; else 90 if the project, or a word of it, is among the activities; else 20."""
    joined = F.lower(F.array_join(activities, " "))
    project = F.lower(F.coalesce(project, F.lit("")))
    words = F.filter(F.split(project, " "), lambda w: w != "")
    hit = (project != "") & (joined.contains(project) | F.exists(words, lambda w: joined.contains(w)))
    return F.when(compatible, 100.0).when(F.coalesce(hit, F.lit(False)), 90.0).otherwise(20.0)


def loan_score(loan: Column, least: Column, most: Column) -> Column:
    known = loan.isNotNull() & (F.coalesce(most, F.lit(0)) != 0)
    floor = F.coalesce(least, F.lit(0)) != 0
    return F.when(~known, 50.0).when(floor & loan.between(least, most), 100.0).when(loan <= most, 80.0).otherwise(0.0)


def cost_score(cost: Column, loan_percentage: Column) -> Column:
    return F.when(cost.isNull(), 50.0).when(F.coalesce(loan_percentage, F.lit(0)) != 0, 70.0).otherwise(60.0)


def other_score(state: Column, freshness: Column, verified: Column, gender: Column, target: Column) -> Column:
    """50, 10 for a state, up to 30 for fresh data, up to 25 for a scheme of the user's gender; 100 at most."""
    gender = F.lower(F.trim(F.coalesce(gender, F.lit(""))))
    target = F.coalesce(F.nullif(F.lower(F.trim(target)), F.lit("")), F.lit("any"))
    said = gender.isin("male", "female")
    total = (
        F.lit(50)
        + F.when(F.coalesce(state, F.lit("")) != "", 10).otherwise(0)
        + F.when(verified.isNull(), 0).when(freshness == "Fresh", 30).when(freshness == "Aging", 15).otherwise(0)
        + F.when(said & (gender == target), 25).when(said & target.isin("any", "both", "all"), 5).otherwise(0)
    )
    return F.least(total, F.lit(100)).cast("double")


def total_score(eligibility: Column, purpose: Column, loan: Column, cost: Column, other: Column, weights: Weights = Weights()) -> Column:
    w = weights
    parts = eligibility * w.eligibility + purpose * w.purpose + loan * w.loan_amount + cost * w.project_cost + other * w.other
    return F.round(parts / max(w.eligibility + w.purpose + w.loan_amount + w.project_cost + w.other, 1.0), 2)


def top(scored: DataFrame, k: int, partition: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The first k rows of each partition; Spark limits each task to k rows of a partition before it shuffles."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return scored.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def detailed(best: DataFrame, most: int = 3) -> DataFrame:
    """Ranked rows with their level of detail: the first ones in full."""
    return best.withColumn("detail_level", F.when(F.col("rank") <= most, "full").otherwise("summary"))


def recommendations(scored: DataFrame, k: int = 10, most: int = 3) -> DataFrame:
    """Eligible schemes of each profile by score, then name and id; the first ones in full detail."""
    best = top(scored.where("eligible"), k, ["profile_id"], [F.desc("score"), F.lower("name"), F.col("scheme_id")])
    return detailed(best, most)


def good_offer() -> Column:
    """A scheme that names a figure and is not a page about something else."""
    junk = F.lower("name").rlike("shared eligibility|support-myscheme|support myscheme|eligibility criteria")
    return F.coalesce(~junk, F.lit(False)) & (F.col("max_loan").isNotNull() | F.col("interest_rate").isNotNull())


def near_misses(scored: DataFrame, k: int = 3) -> DataFrame:
    """For profiles without an eligible scheme: those that fail least. Junk rows only count where there is nothing else.

    Eligible rows, then good ones, come first, so that each task keeps k rows of a profile before the shuffle; what the first row
    of a profile is decides over the others.
    """
    order = [F.desc("eligible"), F.desc("good"), F.col("hard_fails"), F.desc("score"), F.col("soft_fails"), F.lower("name"), F.col("scheme_id")]
    first = top(scored.withColumn("good", good_offer()), k, ["profile_id"], order)
    own = Window.partitionBy("profile_id")
    first = first.withColumns({"any_eligible": F.max("eligible").over(own), "any_good": F.max("good").over(own)})
    return first.where("not any_eligible and (good or not any_good)").drop("any_eligible", "any_good")
