"""Finance, distance and similarity scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
PERIODS = {"monthly": 12, "quarterly": 4, "yearly": 1}


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def periods_per_year(frequency: Column) -> Column:
    out = F.when(F.lit(False), 12)
    for name, n in PERIODS.items():
        out = out.when(frequency == name, n)
    return out.otherwise(12)


def emi_problem(principal: Column, tenure: Column, moratorium: Column) -> Column:
    """Why no instalment can be computed; null if one can."""
    return (
        F.when(principal <= 0, "Loan amount must be positive")
        .when(tenure <= 0, "Tenure must be positive")
        .when(moratorium < 0, "Moratorium cannot be negative")
        .when(moratorium >= tenure, "Moratorium must be less than tenure")
    )


def emi_terms(principal: Column, rate: Column, tenure: Column, moratorium: Column, frequency: Column) -> tuple[Column, Column, Column]:
    """Number of instalments (half-even), rate per period, and the instalment before rounding."""
    per_year = periods_per_year(frequency)
    n = F.greatest(F.lit(1), F.bround((tenure - moratorium) * per_year / 12).cast("int"))
    r = rate / 100.0 / per_year
    grown = F.pow(1 + r, n)
    return n, r, F.when(r == 0, principal / n).otherwise(principal * r * grown / (grown - 1))


def emi(principal: Column, rate: Column, tenure: Column, moratorium: Column, frequency: Column) -> Column:
    """struct<emi, total_interest, total_repayment, warning, error>; figures are null without a rate or with a problem."""
    problem = emi_problem(principal, tenure, moratorium)
    n, _, each = emi_terms(principal, rate, tenure, moratorium, frequency)
    usable = problem.isNull() & rate.isNotNull()
    interest = each * n - principal
    return F.struct(
        F.when(usable, F.round(each, 2)).alias("emi"),
        F.when(usable, F.round(interest, 2)).alias("total_interest"),
        F.when(usable, F.round(principal + interest, 2)).alias("total_repayment"),
        F.when(problem.isNull() & rate.isNull(), "rate_unavailable").when(problem.isNull() & (moratorium > 0), "moratorium_interest_unknown").alias("warning"),
        problem.alias("error"),
    )


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5)
