"""Declared schemas of the domain's tables, and which rows a request may have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "profile": "profile_id long, age int, gender string, category string, annual_family_income double, occupation string, education_status string, "
    "project_type string, project_cost double, loan_required double, purpose string, location string, state string, district string, "
    "existing_loan boolean, session_id string, language string",
    "scheme": "id long, name string, scheme_type string, purpose string, description string, min_income double, max_income double, min_loan double, "
    "max_loan double, interest_rate double, interest_rate_type string, tenure int, moratorium int, loan_percentage double, "
    "categories array<string>, activities array<string>, required_documents array<string>, application_process string, "
    "availability_type string, valid_from timestamp, valid_to timestamp, target_gender string, source_id long, source_url string, "
    "last_verified timestamp, current_version int, status string, canonical_key string",
    "rule": "scheme_id long, ordinal int, rule_type string, operator string, num_value double, lo double, hi double, list_value array<string>, "
    "str_value string, is_hard boolean",
    "partner": "partner_id long, name string, state string, district string, latitude double, longitude double, status string, canonical_key string",
    "mapping": "partner_id long, scheme_id long, eligibility_status string",
    "change": "id long, entity_type string, entity_id long, entity_key string, field_name string, old_value string, new_value string, "
    "scraping_run_id long, status string, reviewed_by long",
    "loan": "loan_id long, principal double, rate double, tenure int, moratorium int, frequency string",
}


def rows(spark: SparkSession, name: str, values: list[dict]) -> DataFrame:
    """A DataFrame of a declared schema; what a row leaves out is null."""
    schema = SCHEMAS[name]
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return spark.createDataFrame([tuple(v.get(n) for n in names) for v in values], schema)


def profile_problem() -> Column:
    """The first bound that a profile breaks; null for a good one."""
    out_of = lambda c, low, high: F.coalesce(~F.col(c).between(low, high), F.lit(False))
    return (
        F.when(out_of("age", 18, 100), "age")
        .when(F.coalesce(F.col("annual_family_income") < 0, F.lit(False)), "annual_family_income")
        .when(F.coalesce(F.col("project_cost") <= 0, F.lit(False)), "project_cost")
        .when(F.coalesce(F.col("loan_required") <= 0, F.lit(False)), "loan_required")
    )


def point_problem() -> Column:
    bad = lambda c, n: F.coalesce(F.abs(F.col(c)) > n, F.lit(True))
    return F.when(bad("lat", 90), "latitude").when(bad("lon", 180), "longitude").when(~F.col("radius_km").between(1, 500), "radius_km")


def accepted(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their problem."""
    marked = df.withColumn("problem", problem)
    return marked.where("problem is null").drop("problem"), marked.where("problem is not null")


def settings_list(text: Column) -> Column:
    """`20,40,60` as numbers; what is no number goes."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def absent(rows_: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Seed rows whose natural key the table lacks: insert-if-absent."""
    return rows_.join(table.select(*keys), keys, "left_anti")
