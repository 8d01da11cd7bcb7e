"""An index of intervals for joins on bounds: points and intervals meet in bins, so bounds are keys of an equi-join and not its residual.

Edges are quantiles of the bounds themselves; a point lies in the bin after all edges below it, and an interval is entered in every bin from that of its low
end to that of its high end. As bins ascend with their values, a point inside an interval always meets it; what the bins can't tell apart is
left to the exact condition, and an upper bound that is an edge leaves nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the entered side up to which more bins are made; bins of a dimension, at most and if the entered side is larger anyway.
ENTERED, MOST_BINS, LEAST_BINS = 200_000, 32, 16
#: The bin of a point without a value, which no bound excludes.
UNSAID = -1


def bins_for(rows: int, dimensions: int, entered: int = ENTERED) -> int:
    """As many bins a dimension as leave the entered side small, at worst one entry for each cell."""
    if rows > entered:
        return LEAST_BINS
    return max(1, min(MOST_BINS, int((entered / max(rows, 1)) ** (1 / dimensions)) - 1))


def edges(rows: DataFrame, bounds: list[tuple[str, str]], bins: int) -> list[list[float]]:
    """For each (low, high) pair of columns, at most bins - 1 ascending edges: the only numbers that reach the driver."""
    if bins < 2:
        return [[] for _ in bounds]
    shares = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    quantiles = [F.percentile_approx(c, shares, 10_000).alias(f"q{i}_{k}") for i, pair in enumerate(bounds) for k, c in enumerate(pair)]
    row = rows.agg(*quantiles).first()
    out = []
    for i in range(len(bounds)):
        found = sorted({float(x) for k in (0, 1) for x in row[f"q{i}_{k}"] or []})
        step = -(-len(found) // (bins - 1)) or 1
        out.append(found[::-1][::step][::-1])  # upper bounds matter most: keep the last of each stretch
    return out


def bin_of(value: Column, edges: list[float]) -> Column:
    """How many edges lie below a value."""
    return reduce(lambda a, e: a + F.when(value > F.lit(e), 1).otherwise(0), edges, F.lit(0))


def point_bin(value: Column, edges: list[float]) -> Column:
    return F.when(value.isNull(), UNSAID).otherwise(bin_of(value, edges))


def interval_bins(low: Column, high: Column, edges: list[float]) -> Column:
    """Array of the bins that an interval is entered in; a null end is open. An interval with its ends the wrong way round holds no value."""
    a = F.when(low.isNull(), 0).otherwise(bin_of(low, edges))
    z = F.when(high.isNull(), len(edges)).otherwise(bin_of(high, edges))
    return F.concat(F.array(F.lit(UNSAID)), F.when(a <= z, F.sequence(a, z)).otherwise(F.array().cast("array<int>")))
