"""Queries on change data, duplicates, runs and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import dates
from loomwork.operators import changes, duplicates, ranking, runs
from loomwork.plans import views
from loomwork.plans.views import view

AS_OF = "2024-02-01 00:00:00"
LONG_AGO = "2001-07-01 00:00:00"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return rows.select(*(rows[n].cast("timestamp").alias(n) if k == "timestamp_ntz" else rows[n] for n, k in rows.dtypes))


def newest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.newest_schemes(view(spark, sf_dir, views.ENTITIES)).select("id", "source_id", "status")


def retired_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.retired(view(spark, sf_dir, views.ENTITIES))


def active_unique_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.newest_schemes(view(spark, sf_dir, views.ENTITIES)).agg(F.count("*").alias("n"))


def latest_run_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"))
    return runs.newest_of(sources, view(spark, sf_dir, views.RUNS), "source_id", ["start_time", "run_id"], ["run_id", "status"])


def run_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "run_id")
    return runs.with_counts(view(spark, sf_dir, views.RUNS), lines, "run_id", "n_changes").select("run_id", "status", "n_changes")


def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, parts = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "part")
    return runs.overview(
        runs.counts(orders, runs=F.lit(True), finished=F.col("o_orderstatus") == "F", urgent=F.col("o_orderpriority").startswith("1")),
        runs.counts(parts, schemes=F.lit(True), small=F.col("p_size") <= 10, unnamed=F.col("p_name").isNull()),
        runs.counts(_read(spark, sf_dir, "supplier"), partners=F.lit(True), in_debt=F.col("s_acctbal") < 0),
    )


def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest runs: an ordered list with a limit, as an administrator sees it."""
    return view(spark, sf_dir, views.RUNS).orderBy(F.desc_nulls_last("start_time"), F.desc("run_id")).limit(100).select("run_id", "source_id", "status")


def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = dates.is_stale_run(F.col("status"), F.col("start_time"), F.col("end_time"), dates.at(LONG_AGO))
    return view(spark, sf_dir, views.RUNS).where(stale).select("run_id", F.lit("failed").alias("status"), runs.appended_note(F.lit(None), F.lit("auto-closed")).alias("notes"))


def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, last = F.col("user_id") % 4 * 600, F.when(F.col("user_id") % 17 != 0, F.col("last"))
    seen = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    status = F.when(F.col("user_id") % 10 == 0, "MANUAL/RESTRICTED").otherwise("ok")
    return seen.where(dates.is_due(F.col("user_id") % 5 != 0, status, last, every, dates.at("2024-01-31 00:00:00"))).select("user_id")


def field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the old snapshot and a batch that alters some of them, adds others and leaves fields out."""
    old, new = _snapshots(spark, sf_dir)
    return changes.differences(old, new, "key", ["name", "balance", "valid_to"])


def merged_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return changes.merged(old.withColumn("version", F.lit(1)), new, "key", ["name", "balance", "valid_to"])


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All customers, as two overlapping states: what only one of them has are inserts, and rows that the batch leaves out."""
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    old = c.where(k % 5 != 0).select(k.alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.when(k % 2 == 0, "2024-12-31").alias("valid_to"))
    new = c.where(k % 3 != 0).select(
        k.alias("key"), F.when(k % 4 != 0, F.col("c_name")).alias("name"), F.when(k % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("balance"),
        F.when(k % 6 == 2, "2024-12-31").alias("valid_to"),
    )
    return old, new


_SNAPSHOTS = """
old as (select c_custkey as key, c_name as name, c_acctbal as balance, case when c_custkey % 2 = 0 then '2024-12-31' end as valid_to from customer where c_custkey % 5 <> 0),
new as (select c_custkey as key, case when c_custkey % 4 <> 0 then c_name end as name, case when c_custkey % 7 = 0 then c_acctbal + 1 else c_acctbal end as balance,
  case when c_custkey % 6 = 2 then '2024-12-31' end as valid_to from customer where c_custkey % 3 <> 0)
"""


def scd2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.versions(view(spark, sf_dir, views.CHANGES)).select("id", "version_number", "effective_to")


def undo_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.undo_verdicts(view(spark, sf_dir, views.CHANGES)).select("id", "can_undo", "has_newer", "undoable")


def flushed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, views.CHANGES)
    values = rows.where("status = 'rejected'").groupBy("entity_id", "field_name").agg(F.min("new_value").alias("value"))
    return changes.applied(values, rows.where("status = 'pending_review'"))


def superseded_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, views.CHANGES)
    fresh = rows.where(F.col("id") % 50 == 1)
    return changes.superseded(rows, fresh).groupBy("status").agg(F.count("*").alias("n"))


def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    approval = spark.createDataFrame([("description", True, False), ("tenure", False, True)], "field_name string, is_sensitive boolean, auto_approve boolean")
    return changes.tagged(view(spark, sf_dir, views.CHANGES), approval).groupBy("field_name", "is_sensitive", "auto_approve").agg(F.count("*").alias("n"))


def change_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, views.CHANGES).withColumn("entity_type", F.lit("scheme"))
    out = runs.grouped_changes(rows)
    return out.select("entity_id", "n", F.array_join(F.transform("changes", lambda c: c.id.cast("string")), ",").alias("ids"))


def change_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("entity_id")
    rows = view(spark, sf_dir, views.CHANGES).withColumns({"entity_type": F.when(e % 2 == 0, "scheme").otherwise("partner"), "entity_key": F.when(e % 3 == 0, F.concat(F.lit("key-"), e.cast("string")))})
    schemes = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("name"))
    partners = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return runs.entity_names(rows, schemes, partners).select("id", "entity_name")


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*(F.lit(x) for x in ("queued", "running", "running", "running", "success", "failed"))), (F.col("event_id") % 6 + 1).cast("int"))
    events = _read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", "ts", kind.alias("event"))
    return changes.run_status(events)


def crawl_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    item = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat_ws(":", F.col("user_id").cast("string"), k.cast("string"))).when(k % 4 == 2, "x:1").otherwise("7:y")
    return runs.crawl_jobs(_read(spark, sf_dir, "events").select("event_id", item.alias("item"))).select("event_id", "source_id", "run_id")


def mapping_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    partners = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("source_id"), F.col("s_suppkey").alias("partner_id"))
    schemes = _read(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("source_id"), F.col("p_partkey").alias("scheme_id"))
    existing = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("partner_id"), F.col("l_partkey").alias("scheme_id"))
    return runs.new_mappings(partners, schemes, existing)


def customer_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top three of each nation by balance: ranks with explicit tie-breaks."""
    top = ranking.top(_read(spark, sf_dir, "customer"), 3, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")])
    return top.select("c_nationkey", "c_custkey", "rank")


def json_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON field, as a number or as its only element, against a bound."""
    k = F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.key")).try_cast("double")
    return _read(spark, sf_dir, "events").groupBy("event_type", (k >= 50).alias("high")).agg(F.count("*").alias("n"))


def citation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    batch = c.where(k % 2 == 0).select(k.alias("id"), F.col("s_name").alias("name"), F.when(k % 3 == 0, F.col("s_acctbal")).alias("rate"), F.lit("new").alias("source_url"))
    old = c.select(k.alias("id"), F.lit("rate").alias("field_name"), F.lit("old").alias("source_url"))
    return changes.citations(batch, old, "id", ["name", "rate"])


_ENTITIES = f"""e as (select *, regexp_replace(regexp_replace(canonical_key, '-for-women|-men', ''), '-+', '-', 'g') as k from {views.sql(views.ENTITIES)} where status <> 'discontinued'),
n as (select *, row_number() over (partition by source_id, k order by coalesce(last_verified, timestamp '1970-01-01') desc, id desc) as rn from e)"""
_CHANGES = f"ch as (select * from {views.sql(views.CHANGES)})"

QUERIES = {
    f.__name__: f
    for f in (
        newest_per_key, retired_duplicates, active_unique_count, latest_run_per_source, run_change_counts, overview_counts, recent_runs, stale_runs,
        due_sources, field_changes, merged_snapshot, scd2_versions, undo_verdicts, flushed_changes, superseded_changes, sensitivity, change_groups,
        change_names, run_states, crawl_jobs, mapping_refresh, customer_bands, json_rules, citation_upsert,
    )
}

ORACLE_SQL = {
    "newest_per_key": f"with {_ENTITIES} select id, source_id, status from n where rn = 1",
    "retired_duplicates": f"with {_ENTITIES} select id from n where rn > 1",
    "active_unique_count": f"with {_ENTITIES} select count(*) as n from n where rn = 1",
    "latest_run_per_source": f"""with r as (select *, row_number() over (partition by source_id order by start_time desc, run_id desc) as rn from {views.sql(views.RUNS)})
      select c_custkey as source_id, run_id as last_run_id, status as last_status from customer left join r on c_custkey = source_id and rn = 1""",
    "run_change_counts": f"""select r.run_id, r.status, count(l_orderkey) as n_changes from {views.sql(views.RUNS)} r left join lineitem on run_id = l_orderkey group by 1, 2""",
    "overview_counts": """select o.*, p.*, s.* from
      (select count(*) as runs, count(*) filter (where o_orderstatus = 'F') as finished, count(*) filter (where o_orderpriority like '1%') as urgent from orders) o,
      (select count(*) as schemes, count(*) filter (where p_size <= 10) as small, count(*) filter (where p_name is null) as unnamed from part) p,
      (select count(*) as partners, count(*) filter (where s_acctbal < 0) as in_debt from supplier) s""",
    "recent_runs": f"select run_id, source_id, status from {views.sql(views.RUNS)} order by start_time desc nulls last, run_id desc limit 100",
    "stale_runs": f"""select run_id, 'failed' as status, 'auto-closed' as notes from {views.sql(views.RUNS)} where end_time is null and
      ((status = 'running' and start_time < timestamp '{LONG_AGO}' - interval 90 minute) or (status = 'queued' and start_time < timestamp '{LONG_AGO}' - interval 30 minute))""",
    "due_sources": """with s as (select user_id, max(ts) as last from events group by 1)
      select user_id from s where user_id % 5 <> 0 and user_id % 10 <> 0 and (user_id % 17 = 0
        or epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(last) >= 60000000 * case when user_id % 4 = 0 then 15 else user_id % 4 * 600 end)""",
    "field_changes": f"""with {_SNAPSHOTS}, b as (select n.*, o.key is null as fresh, o.name as oname, o.balance as obalance, o.valid_to as ovalid from new n left join old o using (key)),
      u as (select key, fresh, 'name' as field_name, oname as old_value, name as new_value from b where name is not null and name is distinct from oname
        union all select key, fresh, 'balance', cast(obalance as varchar), cast(balance as varchar) from b where balance is not null and balance is distinct from obalance
        union all select key, fresh, 'valid_to', ovalid, valid_to from b where valid_to is distinct from ovalid and (valid_to is not null or not fresh))
      select key, case when fresh then 'insert' else 'update' end as change, field_name, old_value, new_value from u""",
    "merged_snapshot": f"""with {_SNAPSHOTS}, b as (select coalesce(o.key, n.key) as key, coalesce(n.name, o.name) as name, coalesce(n.balance, o.balance) as balance,
        case when n.key is not null then n.valid_to else o.valid_to end as valid_to, o.key is null as fresh, o.name as oname, o.balance as ob, o.valid_to as ov
        from old o full join new n on o.key = n.key)
      select key, name, balance, valid_to, case when not fresh and (name is distinct from oname or balance is distinct from ob or valid_to is distinct from ov) then 2 else 1 end as version from b""",
    "scd2_versions": f"""with {_CHANGES} select id, row_number() over w as version_number, lead(effective_from) over w as effective_to from ch
      window w as (partition by entity_id order by effective_from, id)""",
    "undo_verdicts": f"""with {_CHANGES}, c as (select *, status in ('approved', 'auto_approved') and field_name <> 'created' as can_undo from ch),
      d as (select *, coalesce(max(case when can_undo then id end) over (partition by entity_id, field_name) > id, false) as has_newer from c)
      select id, can_undo, has_newer, can_undo and not has_newer as undoable from d""",
    "flushed_changes": f"""with {_CHANGES}, v as (select entity_id, field_name, min(new_value) as value from ch where status = 'rejected' group by 1, 2),
      p as (select entity_id, field_name, arg_max(new_value, id) as nv from ch where status = 'pending_review' group by 1, 2)
      select coalesce(v.entity_id, p.entity_id) as entity_id, coalesce(v.field_name, p.field_name) as field_name, coalesce(nv, value) as value
      from v full join p on v.entity_id = p.entity_id and v.field_name = p.field_name""",
    "superseded_changes": f"""with {_CHANGES}, f as (select distinct entity_id, field_name from ch where id % 50 = 1)
      select case when status = 'pending_review' and f.entity_id is not null then 'superseded' else status end as status, count(*) as n
      from ch left join f using (entity_id, field_name) group by 1""",
    "sensitivity": f"""with {_CHANGES}, t as (select field_name, case field_name when 'description' then true when 'tenure' then false else field_name in ('interest_rate', 'max_loan') end as is_sensitive from ch)
      select field_name, is_sensitive, not is_sensitive as auto_approve, count(*) as n from t group by 1, 2, 3""",
    "change_groups": f"with {_CHANGES} select entity_id, count(*) as n, string_agg(cast(id as varchar), ',' order by id) as ids from ch group by 1",
    "change_names": f"""with {_CHANGES} select ch.id, coalesce(case when entity_id % 2 = 1 then s_name when entity_id % 4 <> 0 then p_name end, case when entity_id % 3 = 0 then 'key-' || entity_id end,
        case when entity_id % 2 = 0 then 'scheme' else 'partner' end || ' #' || entity_id) as entity_name
      from ch left join part on p_partkey = entity_id left join supplier on s_suppkey = entity_id""",
    "run_states": """with e as (select user_id as run_id, ts, event_id, (['queued', 'running', 'running', 'running', 'success', 'failed'])[event_id % 6 + 1] as event from events),
      f as (select *, event in ('success', 'failed') as ends from e)
      select run_id, coalesce(arg_min(event, (ts, event_id)) filter (where ends), arg_max(event, (ts, event_id))) as status from f group by 1""",
    "crawl_jobs": """select event_id, case when event_id % 4 = 0 then event_id else user_id end as source_id, case when event_id % 4 = 1 then event_id end as run_id
      from events where event_id % 4 < 2""",
    "mapping_refresh": """select s_suppkey as partner_id, p_partkey as scheme_id from supplier join part on s_nationkey = p_partkey % 25
      where not exists (select 1 from lineitem where l_suppkey = s_suppkey and l_partkey = p_partkey)""",
    "customer_bands": """with r as (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rank from customer)
      select c_nationkey, c_custkey, rank from r where rank <= 3""",
    "json_rules": """select event_type, try_cast(json_extract_string(props, '$.k') as double) >= 50 as high, count(*) as n from events group by 1, 2""",
    "citation_upsert": """select s_suppkey as id, 'name' as field_name, 'new' as source_url from supplier where s_suppkey % 2 = 0
      union all select s_suppkey, 'rate', case when s_suppkey % 6 = 0 and s_acctbal is not null then 'new' else 'old' end from supplier""",
}
