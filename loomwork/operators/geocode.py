"""Places for points, and points for names, from a table of places: no service, and no nested loop.

Reverse: the nearest place of every point, by rings that widen until each point has one; within a ring points and places meet on a grid (`geo.within`), and the
first ring with a place holds the nearest. Forward: the place whose label is most like a name, by sets of three-character strings; pairs meet on the
rarest strings that a pair as similar as `LEAST_ALIKE` must share, and whole sets decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.operators import geo
from loomwork.session import checkpointed

LEAST_ALIKE = 0.5
#: Half the way around the earth, and how much wider each ring is.
FARTHEST_KM, WIDER = 20_016.0, 4.0


def first_radius(places: DataFrame) -> float:
    """A radius with a few places in it, if they lie evenly in their box; only the number of rounds depends on it."""
    c = lambda f, x: f(x).alias(f"{f.__name__}_{x}")
    box = places.agg(F.count("*").alias("n"), c(F.min, "p_lat"), c(F.max, "p_lat"), c(F.min, "p_lon"), c(F.max, "p_lon")).first()
    if not box.n:
        return FARTHEST_KM
    area = (box.max_p_lat - box.min_p_lat) * (box.max_p_lon - box.min_p_lon) * geo.KM_PER_DEGREE**2
    return max(1.0, math.sqrt(3 * area / (math.pi * box.n)))


def nearest_places(points: DataFrame, places: DataFrame, key: str, radius: float | None = None) -> DataFrame:
    """points(key, lat, lon) -> key, place_id, distance_km of the nearest of places(place_id, p_lat, p_lon); equal distances go to the smaller id.

    Null for points without coordinates, and if there are no places. A place without coordinates is nobody's nearest.
    """
    places = places.select("place_id", "p_lat", "p_lon").where("p_lat is not null and p_lon is not null")
    rest = points.select(key, "lat", "lon").where("lat is not null and lon is not null").dropDuplicates([key])
    radius, found = radius or first_radius(places), None
    while True:
        hits = geo.within(rest, places, min(radius, FARTHEST_KM)).groupBy(key).agg(F.min(F.struct("distance_km", "place_id")).alias("best"))
        hits = checkpointed(hits)
        found = hits if found is None else found.unionByName(hits)
        if radius >= FARTHEST_KM:
            break
        rest = checkpointed(rest.join(hits, key, "left_anti"))
        if rest.isEmpty():
            break
        radius *= WIDER
    return points.select(key).distinct().join(found, key, "left").select(key, "best.place_id", "best.distance_km")


def shape(name: Column) -> Column:
    """The set of three-character strings of a name in lower case, with single blanks and a blank at both ends; empty for an empty name."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[\s,.]+", " "))
    padded = F.concat(F.lit(" "), plain, F.lit(" "))
    pieces = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.array_distinct(pieces))


def _prefixes(rows: DataFrame, key: str, order: DataFrame, alike: float) -> DataFrame:
    """(key, gram): of each set the rarest strings, one of which any set that similar shares."""
    own = Window.partitionBy(key).orderBy("rows", "gram")
    ranked = rows.select(key, F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(order, "gram").withColumn("place", F.row_number().over(own))
    return ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(alike)) + 1).select(key, "gram")


def named_places(asked: DataFrame, places: DataFrame, alike: float = LEAST_ALIKE) -> DataFrame:
    """asked(name) with place_id, label, p_lat, p_lon and likeness of the places(place_id, label, p_lat, p_lon) most like it, null if none is so alike.

    Of equally alike places the one with the smaller id is taken. Every name is looked up once.
    """
    names = checkpointed(asked.select("name").distinct().withColumn("grams", shape(F.col("name"))).where(F.size("grams") > 0))
    labels = checkpointed(places.select("place_id", shape(F.col("label")).alias("grams")).where(F.size("grams") > 0))
    # One order for both sides; strings that only one side has come first, and meet nothing.
    every = names.select(F.explode("grams").alias("gram")).unionAll(labels.select(F.explode("grams").alias("gram")))
    order = checkpointed(every.groupBy("gram").agg(F.count("*").alias("rows")))
    pairs = _prefixes(names, "name", order, alike).join(_prefixes(labels, "place_id", order, alike), "gram").select("name", "place_id").distinct()
    pairs = pairs.join(names, "name").join(labels.withColumnRenamed("grams", "theirs"), "place_id")
    both = F.size(F.array_intersect("grams", "theirs"))
    likeness = F.round(both / (F.size("grams") + F.size("theirs") - both), 4)
    best = pairs.withColumn("likeness", likeness).where(F.col("likeness") >= alike).groupBy("name").agg(F.min(F.struct((-F.col("likeness")).alias("l"), "place_id")).alias("b"))
    hits = best.select("name", F.col("b.place_id").alias("place_id"), (-F.col("b.l")).alias("likeness")).join(places.select("place_id", "label", "p_lat", "p_lon"), "place_id")
    return asked.join(hits, "name", "left")


def query_of(pin_code: Column, district: Column, state: Column, country: str = "India") -> Column:
    """What a form's parts make for a search, without empty ones."""
    parts = F.filter(F.array(pin_code, district, state, F.lit(country)), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(parts, ", ")
