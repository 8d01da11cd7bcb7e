"""Queries on places: the nearest one of every point, and the one most like a name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import geocode
from loomwork.plans import views
from loomwork.plans.views import view

#: Names as people write them: a doubled letter, one left out, other blanks, or only a part.
_NAMES = (
    "case p_partkey % 4 when 0 then replace(p_name, 'l', 'll') when 1 then replace(p_name, 'e', '') when 2 then concat('  ', upper(p_name), ',') else concat(substr(p_name, 1, 5), ' x') end"
)


def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = view(spark, sf_dir, views.PARTNERS).select(F.col("partner_id").alias("place_id"), "p_lat", "p_lon")
    return geocode.nearest_places(view(spark, sf_dir, views.USERS), places, "user_id")


def named_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    places = part.groupBy(F.concat_ws(", ", "p_name", F.lower("p_type")).alias("label")).agg(F.min("p_partkey").alias("place_id"))
    places = places.withColumns({"p_lat": (F.col("place_id") % 90).cast("double"), "p_lon": (F.col("place_id") % 180).cast("double")})
    asked = part.select(geocode.query_of(F.lit(None).cast("string"), F.expr(_NAMES), F.lower("p_type"), "").alias("name")).distinct()
    return geocode.named_places(asked, places).select("name", "place_id", "label", "p_lat", "p_lon", "likeness")


QUERIES = {f.__name__: f for f in (nearest_place, named_place)}

_SHAPE = "list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)))"
_PLAIN = "' ' || trim(regexp_replace(lower({0}), '[\\s,.]+', ' ', 'g')) || ' '"

ORACLE_SQL = {
    "nearest_place": f"""with u as {views.sql(views.USERS)}, q as {views.sql(views.PARTNERS)}, k as (
        select user_id, partner_id, round(2 * 6371.0::double * asin(sqrt(pow(sin(radians(p_lat - lat) / 2), 2)
          + cos(radians(lat)) * cos(radians(p_lat)) * pow(sin(radians(p_lon - lon) / 2), 2))), 2) as distance_km from u cross join q where p_lat is not null),
      n as (select user_id, arg_min(partner_id, (distance_km, partner_id)) as place_id, min(distance_km) as distance_km from k group by 1)
      select user_id, place_id, distance_km from u left join n using (user_id)""",
    "named_place": f"""with l as (select p_name || ', ' || lower(p_type) as label, min(p_partkey) as place_id from part group by 1),
      a as (select distinct {_NAMES} || ', ' || lower(p_type) as name from part),
      ls as (select *, {_SHAPE} as g from (select *, {_PLAIN.format('label')} as s from l)), ns as (select *, {_SHAPE} as g from (select *, {_PLAIN.format('name')} as s from a)),
      p as (select name, place_id, label, round(len(list_intersect(ns.g, ls.g))::double / (len(ns.g) + len(ls.g) - len(list_intersect(ns.g, ls.g))), 4) as likeness from ns cross join ls),
      b as (select name, arg_min(place_id, (-likeness, place_id)) as place_id, max(likeness) as likeness from p where likeness >= 0.5 group by 1)
      select a.name, b.place_id, label, (b.place_id % 90)::double as p_lat, (b.place_id % 180)::double as p_lon, b.likeness from a left join b using (name) left join l on l.place_id = b.place_id""",
}
