"""Partner search: distances within expanding rings, mapped partners first, a listing where nothing is near."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.functions.numbers import haversine_km
from loomwork.session import checkpointed

# The rings in kilometres, and statuses that take part.
STEPS = (20, 40, 60, 100)
MAPPED = ["eligible", "authorized", "active"]
LISTED = ["active", "authorized"]
BARRED = ["suspended", "ineligible", "blacklisted"]
KM_PER_DEGREE = 111.0


def ladder(most: int, steps: tuple[int, ...] = STEPS) -> list[int]:
    """The rings up to the largest radius; that radius alone if it is below all of them."""
    return [s for s in steps if s <= most] or [most]


def allowed(status: Column) -> Column:
    return ~F.coalesce(F.lower(status).isin(BARRED), F.lit(False))


def partner_score(mapped: Column, km: Column, freshness: Column, verified: Column, active: Column) -> Column:
    return F.round(
        F.when(mapped, 40.0).otherwise(20.0)
        + F.greatest(F.lit(0.0), F.lit(30.0) - km)
        + F.when(verified.isNull(), 0.0).when(freshness == "Fresh", 20.0).when(freshness == "Aging", 10.0).when(freshness == "Stale", 2.0).otherwise(0.0)
        + F.when(active, 10.0).otherwise(0.0),
        2,
    )


def within(users: DataFrame, partners: DataFrame, most_km: float) -> DataFrame:
    """users(lat, lon, ...) x partners(p_lat, p_lon, ...) within most_km, with distance_km rounded to 2 digits.

    Both sides meet on a grid, so the join is an equi-join: latitude bands as high as the radius, and in every band as
    many equal longitude cells as are no narrower than what the radius spans there. A user looks into its own and the two
    neighbouring cells of its band, a partner is entered in its own and the two neighbouring bands. Distances decide.
    """
    band = most_km / KM_PER_DEGREE * 1.01
    far = F.greatest(F.abs(F.col("_band") * band), F.abs((F.col("_band") + 1) * band)) + band
    cells = F.when(far >= 89.0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(360.0 / band) * F.cos(F.radians(far)))))
    cell = lambda lon: F.pmod(F.floor((lon + 180.0) / 360.0 * F.col("_cells")), F.col("_cells"))
    near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(cell(F.col("lon")) + d, F.col("_cells"))))
    u = users.withColumn("_band", F.floor(F.col("lat") / band)).withColumn("_cells", cells).withColumn("_cell", F.explode(near))
    p = partners.where("p_lat is not null and p_lon is not null")
    p = p.withColumn("_band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("p_lat") / band) + d)))
    p = p.withColumn("_cells", cells).withColumn("_cell", cell(F.col("p_lon")))
    met = u.drop("_cells").join(p.drop("_cells"), ["_band", "_cell"]).drop("_band", "_cell")
    km = F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")), 2)
    return met.withColumn("distance_km", km).where(F.col("distance_km") <= most_km)


def nearest_ring(hits: DataFrame, user: str, steps: list[int]) -> DataFrame:
    """Of every user's hits, those in the smallest ring that has any, with that ring."""
    ring = F.least(*(F.when(F.col("distance_km") <= s, F.lit(s)) for s in steps)) if len(steps) > 1 else F.when(F.col("distance_km") <= steps[0], F.lit(steps[0]))
    first = F.min("ring").over(Window.partitionBy(user))
    return hits.withColumn("ring", ring).where("ring is not null").withColumn("matched_radius_km", first).where(F.col("distance_km") <= F.col("matched_radius_km")).drop("ring")


def first_ring(users: DataFrame, partners: DataFrame, steps: list[int]) -> DataFrame:
    """users(lat, lon, ...) x partners within the smallest of the steps that has any for a point, with distance_km and matched_radius_km.

    Equal points of users are one row, which the caller joins back by lat and lon. Each ring is searched only for the points that the ones before left without a hit, so few
    pairs are made beyond those that show.
    """
    rest, found = users.select("lat", "lon").distinct(), None
    for step in steps:
        hits = checkpointed(within(rest, partners, step).withColumn("matched_radius_km", F.lit(step)))
        found = hits if found is None else found.unionByName(hits)
        rest = rest.join(hits.select("lat", "lon").distinct(), ["lat", "lon"], "left_anti")
        if step == steps[-1] or rest.isEmpty():
            return found
        rest = checkpointed(rest)


def mapped_partners(partners: DataFrame, mapping: DataFrame, scheme_id: int) -> DataFrame:
    """Partners mapped to a scheme; all active ones, marked unmapped, if the scheme has no mapping."""
    ours = mapping.where((F.col("scheme_id") == scheme_id) & F.col("eligibility_status").isin(MAPPED)).select("partner_id").distinct()
    some = ours.limit(1).select(F.lit(True).alias("_some"))
    mapped = partners.join(ours, "partner_id", "left_semi").where(F.col("status").isin(LISTED)).withColumn("mapped", F.lit(True))
    listed = partners.where("status = 'active'").join(F.broadcast(some), F.lit(True), "left").where("_some is null").drop("_some")
    return mapped.unionByName(listed.withColumn("mapped", F.lit(False)))


def region_search(partners: DataFrame, state: str, district: str | None = None) -> DataFrame:
    """Partners of a state, or without one, by case-insensitive substring; mapped ones only if there are any."""
    found = partners.where(F.col("state").ilike(f"%{state}%") | F.col("state").isNull() | (F.col("state") == ""))
    if district:
        found = found.where(F.col("district").ilike(f"%{district}%"))
    if "mapped" not in partners.columns:
        return found
    some = found.where("mapped").limit(1).select(F.lit(True).alias("_some"))  # one row at most
    return found.join(F.broadcast(some), F.lit(True), "left").where("mapped or _some is null").drop("_some")
