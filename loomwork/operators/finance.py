"""Amortisation schedules as rows, in closed form: no running state, so any period can be computed by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.numbers import emi, emi_problem, emi_terms

TERMS = ("principal", "rate", "tenure", "moratorium", "frequency")


def with_emi(loans: DataFrame) -> DataFrame:
    """loans(principal, rate, tenure, moratorium, frequency) with emi, totals, warning and error."""
    return loans.withColumn("_e", emi(*(F.col(c) for c in TERMS))).select(*loans.columns, "_e.*")


def schedule(loans: DataFrame, key: str) -> DataFrame:
    """(key, period, emi, principal, interest, balance) of every loan that has an instalment."""
    n, r, each = emi_terms(*(F.col(c) for c in TERMS))
    usable = loans.where(emi_problem(F.col("principal"), F.col("tenure"), F.col("moratorium")).isNull() & F.col("rate").isNotNull())
    rows = usable.select(key, F.col("principal").alias("p"), n.alias("n"), r.alias("r"), each.alias("e")).withColumn("period", F.explode(F.sequence(F.lit(1), F.col("n"))))
    # After k instalments p(1+r)^k - e((1+r)^k - 1)/r is left, or p - ke without interest.
    left = lambda k: F.when(F.col("r") == 0, F.col("p") - F.col("e") * k).otherwise(F.col("p") * F.pow(1 + F.col("r"), k) - F.col("e") * (F.pow(1 + F.col("r"), k) - 1) / F.col("r"))
    rows = rows.withColumn("before", F.greatest(F.lit(0.0), left(F.col("period") - 1)))
    rows = rows.withColumn("interest", F.col("before") * F.col("r")).withColumn("part", F.least(F.col("e") - F.col("interest"), F.col("before")))
    return rows.select(
        key, F.col("period").cast("long").alias("period"), F.round(F.col("part") + F.col("interest"), 2).alias("emi"), F.round("part", 2).alias("principal"),
        F.round("interest", 2).alias("interest"), F.round(F.greatest(F.lit(0.0), F.col("before") - F.col("part")), 2).alias("balance"),
    )
