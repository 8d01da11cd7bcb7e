"""Rows as they are shown and stored: cards, guidance, labels, availability, places, side outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwork.session import small

# What to do next, where a scheme has no guidance of its own.
NEXT_STEPS = [
    "Confirm your eligibility against the official scheme page.",
    "Identify the recommended channel partner.",
    "Contact or visit the partner.",
    "Carry the required documents listed from official sources.",
    "Ask the partner to confirm current scheme availability.",
    "Complete the official application process with the partner.",
]
MESSAGE_LENGTH = 4_000
OFFERED = ["interest_rate", "max_loan", "tenure", "required_documents"]


def unavailable(fields: dict[str, Column]) -> Column:
    """Names of the fields that are null, in order."""
    return F.filter(F.array(*(F.when(c.isNull(), F.lit(n)) for n, c in fields.items())), lambda x: x.isNotNull())


def availability(df: DataFrame) -> DataFrame:
    """struct<field: boolean>: whether a field has a value; an empty list is none."""
    has = lambda n: (F.coalesce(F.size(n), F.lit(0)) > 0) if dict(df.dtypes)[n].startswith("array") else F.col(n).isNotNull()
    return df.withColumn("field_availability", F.struct(*(has(n).alias(n) for n in OFFERED if n in df.columns)))


def with_guidance(schemes: DataFrame, guidance: DataFrame) -> DataFrame:
    """Each scheme's steps, or the general ones. guidance(scheme_id, steps); of several rows of a scheme the first by id."""
    own = guidance.groupBy("scheme_id").agg(F.min_by("steps", "id").alias("_steps"))
    return schemes.join(own, "scheme_id", "left").withColumn("steps", F.coalesce("_steps", F.array(*map(F.lit, NEXT_STEPS)))).drop("_steps")


def cards(scored: DataFrame, citations: DataFrame) -> DataFrame:
    """(profile_id, scheme_id, card): a JSON card of each row with its scheme's citations in order of field."""
    cited = citations.groupBy("scheme_id").agg(F.array_sort(F.collect_list(F.struct("field_name", "source_url"))).alias("citations"))
    out = scored.join(cited, "scheme_id", "left").withColumn("citations", F.coalesce("citations", F.array().cast("array<struct<field_name:string,source_url:string>>")))
    shown = [c for c in out.columns if c != "profile_id"]
    return out.select("profile_id", "scheme_id", F.to_json(F.struct(*shown)).alias("card"))


def known_columns(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Only what the table has columns for, in its order."""
    return rows.select(*(c for c in table.columns if c in rows.columns))


def error_rows(failed: DataFrame, kind: str) -> DataFrame:
    """Side output of what could not be read: source, address, kind and the message's beginning."""
    return failed.select("source_id", "url", F.lit(kind).alias("error_type"), F.substring("message", 1, MESSAGE_LENGTH).alias("message"))


def audit_rows(actions: DataFrame, at: Column) -> DataFrame:
    """Events of who did what to which row, details as JSON."""
    return actions.select("user_id", "action", "entity_type", F.col("entity_id").cast("string").alias("entity_id"), F.to_json("details").alias("details"), at.alias("created_at"))


def updated(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Only the fields that a patch row sets change: patch(key, fields map<string, string>); a field set to null becomes null."""
    p = patch.select(key, F.col("fields").alias("_f"))
    out = rows.join(p, key, "left")
    for name, kind in rows.dtypes:
        if name != key:
            out = out.withColumn(name, F.when(F.map_contains_key(F.coalesce("_f", F.create_map().cast("map<string,string>")), name), F.col("_f")[name].try_cast(kind)).otherwise(F.col(name)))
    return out.drop("_f")


def shared_ceiling(schemes: DataFrame, shared: DataFrame) -> DataFrame:
    """Income ceilings that a source states for all its schemes fill those of live schemes; the stated one wins."""
    s = shared.groupBy("source_id").agg(F.max("max_income").alias("_max"))
    live = F.col("status") == "active"
    return schemes.join(s, "source_id", "left").withColumn("max_income", F.when(live, F.coalesce("_max", "max_income")).otherwise(F.col("max_income"))).drop("_max")


def mappable(partners: DataFrame) -> DataFrame:
    return partners.where("latitude is not null and longitude is not null")


def circle_metres(km: Column) -> Column:
    return km * 1000


def filtered(df: DataFrame, text: Column, needle: str = "", category: str = "", of: str = "category") -> DataFrame:
    """Rows with a substring and a category, either of which may be left open; case doesn't count."""
    out = df.where(F.lower(text).contains(needle.lower())) if needle else df
    return out.where(F.lower(of) == category.lower()) if category else out


def coded(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """A column's label, or the code where there is none. labels(code, label): a table of codes, small by nature."""
    names = labels.select(F.col("code").alias(column), F.col("label").alias("_l"))
    return df.join(small(names), column, "left").withColumn(f"{column}_label", F.coalesce("_l", column)).drop("_l")


def best_source(found: DataFrame, key: str, rank: str) -> DataFrame:
    """Of several searches for a request, the rows of the first that found any."""
    return found.withColumn("_b", F.min(rank).over(Window.partitionBy(key))).where(F.col(rank) == F.col("_b")).drop("_b")


def resolved_places(asked: DataFrame, places: DataFrame) -> DataFrame:
    """asked(name) with `place` of places(ord, place): the exact name, else one that contains it or is contained, the first by ord.

    places is a fixed table of states or districts; bracketed parts of its names don't count for containment.
    """
    low = F.trim(F.regexp_replace(F.lower("name"), r"\s+", " "))
    base = F.lower(F.substring_index("place", " (", 1))
    p = small(places)
    exact, inside = F.lower("place") == low, base.contains(low) | low.contains(base)
    names = asked.select("name").where(F.trim("name") != "").distinct()
    hits = names.join(p, exact | inside).groupBy("name").agg(F.min_by("place", F.struct((~exact).alias("rest"), F.col("ord"))).alias("place"))
    return asked.join(hits, "name", "left")


def address_parts(address: Column) -> tuple[Column, Column]:
    """State and district of an address map, by the order in which keys are trusted; a district that repeats the state gives way."""
    pick = lambda *names: F.coalesce(*(F.nullif(address[n], F.lit("")) for n in names))
    state = pick("state", "region", "state_district")
    district = pick("state_district", "county", "city_district", "district", "city", "town", "municipality")
    same = F.lower(F.trim(district)) == F.lower(F.trim(state))
    return state, F.when(F.coalesce(same, F.lit(False)), pick("city", "town", "suburb")).otherwise(district)


def district_table(texts: DataFrame) -> DataFrame:
    """(state, district), distinct, from JSON of either shape: {state: [districts]} or {states: [{state, districts}]}."""
    as_map = F.from_json("json", "map<string,array<string>>")
    listed = F.from_json("json", "struct<states: array<struct<state: string, districts: array<string>>>>")
    one = texts.select(F.explode(as_map).alias("state", "districts")).where("state <> 'states'")
    two = texts.select(listed.alias("l")).select(F.inline("l.states"))
    both = one.unionByName(two.select("state", "districts"))
    return both.select("state", F.explode("districts").alias("district")).where("district is not null").distinct()


def purposes(schemes: DataFrame) -> DataFrame:
    return schemes.where("purpose is not null and purpose <> ''").select("purpose").distinct().orderBy("purpose")


def any_busy(runs: DataFrame) -> DataFrame:
    return runs.agg(F.coalesce(F.bool_or(F.col("status").isin("queued", "running")), F.lit(False)).alias("busy"))
