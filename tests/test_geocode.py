"""Nearest places and places by name, against SQL and brute force."""

import math
import random

from loomwork.operators import geocode
from loomwork.plans import places
from tests.oracles import same_as_sql


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return round(2 * 6371.0 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)), 2)


def test_queries_equal_sql(spark):
    same_as_sql(spark, places, "nearest_place", "named_place")


def test_no_nested_loops(spark):
    for query in places.QUERIES.values():
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_over_the_whole_globe(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(40)] + [(40, 90.0, 0.0), (41, -90.0, 12.0), (42, 0.0, 179.99), (43, None, 1.0)]
    spots = [(i, rng.uniform(60, 89), rng.uniform(-180, 180)) for i in range(5)] + [(5, 0.0, -179.99), (6, 0.0, -179.99), (7, None, 3.0)]
    p = spark.createDataFrame(points, "user_id int, lat double, lon double")
    q = spark.createDataFrame(spots, "place_id int, p_lat double, p_lon double")
    for radius in (None, 50.0, 30_000.0):
        got = {r.user_id: (r.distance_km, r.place_id) for r in geocode.nearest_places(p, q, "user_id", radius).collect()}
        want = {i: min((km(a, o, b, c), k) for k, b, c in spots if b is not None) if a is not None else (None, None) for i, a, o in points}
        assert got == want
    assert {r.place_id for r in geocode.nearest_places(p, q.limit(0), "user_id").collect()} == {None}


def test_names_most_alike(spark):
    labels = ["New Delhi, Delhi", "Delhi Cantt", "Guwahati, Assam", "guwahati  assam", "Pune", ""]
    q = spark.createDataFrame([(i, x, 1.0 * i, 2.0) for i, x in enumerate(labels)], "place_id int, label string, p_lat double, p_lon double")
    asked = spark.createDataFrame([("Guwahatti, Assam",), ("PUNE",), ("nowhere at all",), ("",), (None,), ("PUNE",)], "name string")
    got = sorted(((r.name, r.place_id) for r in geocode.named_places(asked, q).collect()), key=str)
    assert got == sorted([("Guwahatti, Assam", 2), ("PUNE", 4), ("PUNE", 4), ("nowhere at all", None), ("", None), (None, None)], key=str)
