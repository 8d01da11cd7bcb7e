"""The domain's tables derived from the driver's tables, by expressions that Spark and the SQL oracles read alike.

Profiles come from customer, schemes and partners from supplier, loans and runs from orders, changes from events. Each view is a list of
(source table, expressions, condition), so that a query's DataFrame and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-02-01 00:00:00"

PROFILES = (
    "customer",
    [
        "c_custkey as profile_id",
        "cast(18 + c_custkey % 50 as int) as age",
        "case c_custkey % 4 when 0 then 'male' when 1 then 'female' when 2 then 'prefer_not_to_say' else null end as gender",
        "case c_custkey % 5 when 0 then 'SC' when 1 then 'ST' when 2 then 'OBC' when 3 then 'General' else null end as category",
        "case when c_custkey % 11 = 0 then null else abs(c_acctbal) * 60 end as annual_family_income",
        "case when c_custkey % 7 = 0 then null else cast(20000 + (c_custkey * 7919) % 480000 as double) end as loan_required",
        "case when c_custkey % 3 = 0 then null else cast(30000 + (c_custkey * 104729) % 900000 as double) end as project_cost",
        "case c_mktsegment when 'AUTOMOBILE' then 'business' when 'BUILDING' then 'Self-Employment' when 'FURNITURE' then 'education'"
        " when 'HOUSEHOLD' then 'educational_loan' else 'agriculture' end as purpose",
        "case c_custkey % 4 when 0 then 'dairy' when 1 then 'tailoring shop' when 2 then 'kirana' else null end as project_type",
        "case when c_custkey % 6 = 0 then null else concat('S', cast(c_nationkey as varchar(9))) end as state",
    ],
)
SCHEMES = (
    "supplier",
    [
        "s_suppkey as scheme_id",
        "s_name as name",
        "case s_suppkey % 5 when 0 then 'business' when 1 then 'education' when 2 then 'term_loan' when 3 then null else 'micro_finance' end as purpose",
        "case s_suppkey % 3 when 0 then 'term_loan' when 1 then 'educational_loan' else null end as scheme_type",
        "case when s_suppkey % 4 = 0 then null else cast(100000 + (s_suppkey * 31337) % 500000 as double) end as max_income",
        "case when s_suppkey % 9 = 0 then cast(50000 as double) else null end as min_income",
        "case when s_suppkey % 10 = 3 then null else cast(100000 + (s_suppkey * 7001) % 400000 as double) end as max_loan",
        "case when s_suppkey % 6 = 0 then cast(25000 as double) else null end as min_loan",
        "case s_suppkey % 8 when 1 then 'female' when 2 then 'male' when 3 then 'any' else null end as target_gender",
        "case s_suppkey % 3 when 0 then 'sc,st' when 1 then null else 'obc,sc' end as categories",
        "case s_suppkey % 4 when 0 then 'dairy farm,poultry' when 1 then 'tailoring' else null end as activities",
        "case when s_suppkey % 2 = 0 then cast(90 as double) else null end as loan_percentage",
        "case when s_suppkey % 7 = 0 then null else cast(4 + s_suppkey % 9 as double) end as interest_rate",
        "cast(s_suppkey % 50 as int) as age_days",
    ],
)
PARTNERS = (
    "supplier",
    [
        "s_suppkey as partner_id",
        "s_name as partner",
        "case when s_suppkey % 12 = 0 then null else cast(8 + (s_suppkey * 7919) % 2800 / cast(100 as double) as double) end as p_lat",
        "case when s_suppkey % 12 = 0 then null else cast(68 + (s_suppkey * 104729) % 2900 / cast(100 as double) as double) end as p_lon",
        "case s_suppkey % 10 when 0 then 'suspended' when 1 then 'active' when 2 then 'Blacklisted' else null end as operational",
        "cast(s_suppkey % 50 as int) as age_days",
        "s_nationkey",
    ],
)
USERS = (
    "customer",
    [
        "c_custkey as user_id",
        "cast(8 + (c_custkey * 15485863) % 2800 / cast(100 as double) as double) as lat",
        "cast(68 + (c_custkey * 32452843) % 2900 / cast(100 as double) as double) as lon",
    ],
)
LOANS = (
    "orders",
    [
        "o_orderkey as loan_id",
        "case when o_orderkey % 97 = 0 then cast(0 as double) else o_totalprice + cast(0.00137 as double) end as principal",
        "case o_orderkey % 10 when 0 then null when 1 then cast(0 as double) else cast(4 + o_orderkey % 9 as double) end as rate",
        "cast(12 + (o_orderkey % 6) * 12 as int) as tenure",
        "cast(case o_orderkey % 4 when 0 then 6 when 1 then 12 else 0 end as int) as moratorium",
        "case o_orderkey % 3 when 0 then 'monthly' when 1 then 'quarterly' else 'yearly' end as frequency",
    ],
)
ENTITIES = (
    "events",
    [
        "event_id as id",
        "user_id as source_id",
        "concat(event_type, case event_id % 4 when 0 then '-for-women' when 1 then '-men' else '' end, '-scheme') as canonical_key",
        "case event_id % 9 when 0 then null else ts end as last_verified",
        "case event_id % 10 when 0 then 'discontinued' when 1 then 'unavailable' else 'active' end as status",
    ],
)
RUNS = (
    "orders",
    [
        "o_orderkey as run_id",
        "o_custkey as source_id",
        "o_orderdate as start_time",
        "case when o_orderkey % 3 = 0 then null else o_orderdate end as end_time",
        "case o_orderstatus when 'F' then 'success' when 'O' then 'running' else 'queued' end as status",
    ],
)
CHANGES = (
    "events",
    [
        "event_id as id",
        "user_id as entity_id",
        "case event_type when 'view' then 'interest_rate' when 'click' then 'max_loan' when 'purchase' then 'description'"
        " when 'signup' then 'created' else 'tenure' end as field_name",
        "value as new_value",
        "ts as effective_from",
        "case event_id % 5 when 0 then 'pending_review' when 1 then 'rejected' when 2 then 'approved' else 'auto_approved' end as status",
    ],
)


def view(spark: SparkSession, sf_dir: str, of: tuple) -> DataFrame:
    table, expressions = of
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    for name, kind in rows.dtypes:
        if kind == "timestamp_ntz":
            rows = rows.withColumn(name, rows[name].cast("timestamp"))
    return rows.selectExpr(*expressions)


def sql(of: tuple) -> str:
    table, expressions = of
    return f"(select {', '.join(expressions)} from {table})"
