"""Partners in the first ring that has any: equal to SQL, each point searched once, and no pair of a wider ring for points that are settled."""

from pyspark.sql import functions as F

from loomwork.operators import geo
from loomwork.plans import matching
from tests.oracles import same_as_sql


def test_queries_equal_sql(spark):
    same_as_sql(spark, matching, "geo_partner_search", "radius_ladder")


def test_pairs_stay_in_the_first_ring(spark):
    users = spark.range(50).select(F.col("id").alias("user_id"), F.lit(20.0).alias("lat"), F.when(F.col("id") < 40, 75.0).otherwise(77.0).alias("lon"))
    at = spark.createDataFrame([(1, 20.0, 75.0), (2, 20.3, 75.0), (3, 20.5, 75.0), (4, 20.5, 77.0)], "partner_id int, p_lat double, p_lon double")
    hits = geo.first_ring(users, at, geo.ladder(100))
    got = {(r.lon, r.partner_id, r.matched_radius_km) for r in hits.collect()}
    assert got == {(75.0, 1, 20), (77.0, 4, 60)} and hits.count() == 2
    old = geo.nearest_ring(geo.within(users, at, 100), "user_id", geo.ladder(100))
    assert {(r.lon, r.partner_id, r.matched_radius_km) for r in old.collect()} == got
