"""Queries on promotion: a batch of staged records against schemes, what it changes, versions, review and undo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import changes, promotion
from loomwork.plans import views
from loomwork.plans.views import view

AS_OF = "2024-02-01 00:00:00"
_STATUS = "case when s_suppkey % 13 = 0 then 'discontinued' when s_suppkey % 10 = 0 then 'unavailable' else 'active' end as status"
_VALUES = [
    "s_nationkey as source_id",
    "s_name as name",
    "cast(null as varchar(9)) as description",
    "cast(100000 + (s_suppkey * 7) % 4000 as double) as max_loan",
    "case when s_suppkey % 5 = 0 then null else cast(4 + s_suppkey % 9 as double) end as interest_rate",
    "case when s_suppkey % 2 = 0 then '2024-12-31' else null end as valid_to",
    "cast(1 + s_suppkey % 3 as int) as current_version",
    _STATUS,
]
SCHEMES = ("supplier", ["s_suppkey as id", "concat('loan-', cast(s_suppkey as varchar(9)), case when s_suppkey % 4 = 0 then '-women' else '' end) as canonical_key", *_VALUES])
VARIANTS = ("supplier", ["s_suppkey + 1000000 as id", "concat('loan-', cast(s_suppkey as varchar(9)), '-men') as canonical_key", *_VALUES])
STAGING = (
    "supplier",
    [
        "s_suppkey as staging_id",
        "concat(case when s_suppkey % 3 = 0 then 'loan-' else 'new-' end, cast(s_suppkey as varchar(9))) as entity_key",
        "s_nationkey as source_id",
        "s_suppkey % 7 <> 0 as good",
        "case when s_suppkey % 5 = 0 then concat(s_name, ' renamed') else s_name end as name",
        "cast(null as varchar(9)) as description",
        "case when s_suppkey % 2 = 0 then cast(100000 + (s_suppkey * 7) % 4000 as double) else cast(250000 as double) end as max_loan",
        "case when s_suppkey % 4 = 1 then null else cast(4 + s_suppkey % 9 as double) end as interest_rate",
        "case when s_suppkey % 9 = 0 then '2024-12-31' else null end as valid_to",
    ],
)


def _promoted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    schemes = view(spark, sf_dir, SCHEMES).unionByName(view(spark, sf_dir, VARIANTS).where("id % 6 = 1000000 % 6"))
    schemes = schemes.withColumns({"last_verified": F.lit(None).cast("timestamp"), "source_url": F.lit("u")})
    staging = promotion.gated(view(spark, sf_dir, STAGING).where("staging_id % 3 < 2").withColumn("source_url", F.lit("u")), F.col("good"))
    return promotion.promoted_schemes(staging.where("status = 'compared'").drop("good", "status"), schemes, AS_OF)


def promoted_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, *_ = _promoted(spark, sf_dir)
    return rows.select("canonical_key", "name", "max_loan", "interest_rate", "valid_to", "current_version", "status", F.col("last_verified").isNotNull().alias("verified"))


def promotion_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows, _ = _promoted(spark, sf_dir)
    return rows.select("entity_key", "field_name", "old_value", "new_value", "is_sensitive", "status")


def promotion_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, rows = _promoted(spark, sf_dir)
    return rows.groupBy("version_number", F.get_json_object("snapshot", "$.status").alias("status")).agg(F.count("*").alias("n"))


def staging_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging = promotion.gated(view(spark, sf_dir, STAGING), F.col("good"))
    own = staging.select(F.when(F.col("staging_id") % 2 == 0, F.col("staging_id")).alias("scraping_run_id"), (F.col("staging_id") % 50).alias("raw_document_id"), "status")
    documents = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey < 40").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 10).alias("scraping_run_id"))
    return promotion.stamped(own, documents).groupBy("scraping_run_id", "status").agg(F.count("*").alias("n"))


_PARTNERS = ("supplier", ["s_suppkey as id", "concat('p-', cast(s_suppkey as varchar(9))) as canonical_key", "s_name as name", "concat('tel-', cast(s_suppkey as varchar(9))) as phone", "concat('street ', cast(s_nationkey as varchar(9))) as address", "'active' as status"])
_PARTNER_BATCH = (
    "supplier",
    [
        "s_suppkey as staging_id",
        "concat(case when s_suppkey % 4 = 0 then 'q-' else 'p-' end, cast(s_suppkey as varchar(9))) as entity_key",
        "case when s_suppkey % 8 = 0 then null else s_name end as name",
        "case when s_suppkey % 3 = 0 then 'new phone' else concat('tel-', cast(s_suppkey as varchar(9))) end as phone",
        "case when s_suppkey % 5 = 0 then null else concat('street ', cast(s_nationkey as varchar(9))) end as address",
        "case when s_suppkey % 6 = 1 then 'suspended' else null end as status",
    ],
)


def _partners(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = view(spark, sf_dir, _PARTNERS).withColumn("last_verified", F.lit(None).cast("timestamp"))
    return promotion.promoted_partners(view(spark, sf_dir, _PARTNER_BATCH).where("staging_id % 2 = 0 or staging_id % 3 = 1"), old, AS_OF)


def partner_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _partners(spark, sf_dir)
    return rows.select("canonical_key", "name", "phone", "address", "status", F.col("last_verified").isNotNull().alias("verified"))


def partner_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partners(spark, sf_dir)[1].select("entity_key", "field_name", "old_value", "new_value", "status")


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf_dir, views.CHANGES).withColumns({"new_value": F.col("new_value").cast("string"), "old_value": F.concat(F.lit("was "), F.col("id").cast("string")), "reviewed_by": F.lit(None).cast("int")})
    entities = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4 + 1).cast("int").alias("current_version"), F.lit(None).cast("timestamp").alias("last_verified"))
    return rows, entities


def review_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities after all waiting changes are applied: one version more for each."""
    rows, entities = _history(spark, sf_dir)
    out, _ = promotion.bumped(entities, promotion.flushed(rows)[1], AS_OF)
    return out.select("id", "current_version", F.col("last_verified").isNotNull().alias("verified"))


def review_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, entities = _history(spark, sf_dir)
    return promotion.bumped(entities, promotion.flushed(rows)[1], AS_OF)[1]


def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _history(spark, sf_dir)
    decisions = rows.where("status = 'pending_review'").select("id", (F.col("id") % 3 == 0).alias("approve"))
    return promotion.reviewed(rows, decisions, 7).groupBy("status", "reviewed_by").agg(F.count("*").alias("n"))


def undo_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of asking to undo every tenth change: the values given back, or why not."""
    rows, _ = _history(spark, sf_dir)
    _, back, refused = promotion.undo(rows, rows.where("id % 10 = 3").select("id"), 7)
    return back.select("id", F.col("new_value").alias("answer")).unionByName(refused.select("id", F.col("problem").alias("answer")))


def undo_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _history(spark, sf_dir)
    now = changes.applied(rows.where("status = 'rejected'").groupBy("entity_id", "field_name").agg(F.min("new_value").alias("value")), rows.where("status in ('approved', 'auto_approved')"))
    return changes.applied(now, promotion.undo(rows, rows.where("id % 10 = 3").select("id"), 7)[1])


QUERIES = {
    f.__name__: f
    for f in (
        promoted_snapshot, promotion_changes, promotion_versions, staging_states, partner_upsert, partner_changes, review_flush, review_versions, review_decisions,
        undo_requests, undo_values,
    )
}

_PROMOTED = f"""
s as (select * from {views.sql(SCHEMES)} union all select * from {views.sql(VARIANTS)} where id % 6 = 1000000 % 6),
st as (select * from {views.sql(STAGING)} where staging_id % 3 < 2 and good),
l as (select *, regexp_replace(canonical_key, '-(women|men)$', '') as norm from s where status in ('active', 'unavailable')),
nr as (select st.staging_id, arg_min(l.id, (not (contains(lower(l.name), lower(st.name)) or contains(lower(st.name), lower(l.name))), l.id)) as near
  from st join l on l.source_id = st.source_id and l.norm = st.entity_key group by 1),
m as (select st.*, coalesce(x.id, nr.near) as sid from st left join s x on x.canonical_key = st.entity_key left join nr using (staging_id)),
k as (select m.sid, m.entity_key, s.name as oname, m.name, s.canonical_key as okey, s.max_loan as omax, m.max_loan, s.interest_rate as orate, m.interest_rate,
    s.valid_to as ovalid, m.valid_to from m join s on s.id = m.sid),
ch as (select sid, entity_key, 'name' as field_name, oname as old_value, name as new_value from k where name <> oname
  union all select sid, entity_key, 'canonical_key', okey, entity_key from k where entity_key <> okey
  union all select sid, entity_key, 'max_loan', cast(omax as varchar), cast(max_loan as varchar) from k where max_loan <> omax
  union all select sid, entity_key, 'interest_rate', cast(orate as varchar), cast(interest_rate as varchar) from k where interest_rate is not null and interest_rate is distinct from orate
  union all select sid, entity_key, 'valid_to', ovalid, valid_to from k where valid_to is distinct from ovalid),
t as (select distinct sid from ch),
a as (select s.id, s.source_id, coalesce(k.entity_key, s.canonical_key) as canonical_key, coalesce(k.name, s.name) as name, coalesce(k.max_loan, s.max_loan) as max_loan,
    coalesce(k.interest_rate, s.interest_rate) as interest_rate, case when k.sid is null then s.valid_to else k.valid_to end as valid_to,
    s.current_version + case when t.sid is null then 0 else 1 end as current_version, s.status, t.sid is not null as touched
  from s left join k on k.sid = s.id left join t on t.sid = s.id),
b as (select *, regexp_replace(canonical_key, '-(women|men)$', '') as norm from a),
w as (select source_id, norm, min(id) as lo, max(id) as hi from b where touched group by 1, 2),
r as (select b.canonical_key, b.name, b.max_loan, b.interest_rate, b.valid_to, b.current_version,
    case when b.status in ('active', 'unavailable') and (w.lo <> b.id or w.hi <> b.id) then 'discontinued' else b.status end as status, b.touched as verified
  from b left join w on w.source_id = b.source_id and w.norm = b.norm),
n as (select entity_key as canonical_key, name, max_loan, interest_rate, valid_to, 1 as current_version, 'active' as status, true as verified from m where sid is null)
"""
_HISTORY = f"ch as (select *, cast(new_value as varchar) as nv, 'was ' || id as ov from {views.sql(views.CHANGES)})"
_UNDO = f"""{_HISTORY}, c as (select *, status in ('approved', 'auto_approved') and field_name <> 'created' as can from ch),
u as (select *, coalesce(max(case when can then id end) over (partition by entity_id, field_name) > id, false) as newer from c)"""

ORACLE_SQL = {
    "promoted_snapshot": f"with {_PROMOTED} select * from r union all select * from n",
    "promotion_changes": f"""with {_PROMOTED}, every as (select entity_key, field_name, old_value, new_value from ch
        union all select entity_key, 'max_loan', null, cast(max_loan as varchar) from m where sid is null
        union all select entity_key, 'interest_rate', null, cast(interest_rate as varchar) from m where sid is null and interest_rate is not null)
      select *, field_name in ('max_loan', 'interest_rate') as is_sensitive, 'auto_approved' as status from every""",
    "promotion_versions": f"with {_PROMOTED} select current_version as version_number, status, count(*) as n from (select * from r where verified union all select * from n) group by 1, 2",
    "staging_states": f"""with x as (select staging_id, case when staging_id % 2 = 0 then staging_id end as run, staging_id % 50 as raw, good from {views.sql(STAGING)})
      select coalesce(run, p_partkey * 10) as scraping_run_id, case when good then 'compared' else 'rejected_non_scheme' end as status, count(*) as n
      from x left join (select * from part where p_partkey < 40) on p_partkey = raw group by 1, 2""",
    "partner_upsert": f"""with o as {views.sql(_PARTNERS)}, b as (select * from {views.sql(_PARTNER_BATCH)} where staging_id % 2 = 0 or staging_id % 3 = 1)
      select coalesce(o.canonical_key, b.entity_key) as canonical_key, case when o.id is null then coalesce(b.name, 'Unnamed partner') else o.name end as name, coalesce(b.phone, o.phone) as phone,
        coalesce(b.address, o.address) as address, coalesce(b.status, o.status, 'active') as status, b.entity_key is not null as verified from o full join b on o.canonical_key = b.entity_key""",
    "partner_changes": f"""with o as {views.sql(_PARTNERS)}, b as (select * from {views.sql(_PARTNER_BATCH)} where staging_id % 2 = 0 or staging_id % 3 = 1),
      j as (select b.*, o.id, o.phone as op, o.address as oa, o.status as os from b left join o on o.canonical_key = b.entity_key)
      select entity_key, 'created' as field_name, null as old_value, name as new_value, 'auto_approved' as status from j where id is null
      union all select entity_key, 'phone', op, phone, 'auto_approved' from j where id is not null and phone <> op
      union all select entity_key, 'address', oa, address, 'auto_approved' from j where id is not null and address <> oa
      union all select entity_key, 'status', os, status, 'auto_approved' from j where id is not null and status <> os""",
    "review_flush": f"""with {_HISTORY}, p as (select entity_id, count(*) as n from ch where status = 'pending_review' group by 1)
      select c_custkey as id, cast(c_custkey % 4 + 1 + coalesce(n, 0) as int) as current_version, n is not null as verified from customer left join p on entity_id = c_custkey""",
    "review_versions": f"""with {_HISTORY} select entity_id, id as change_id, cast(entity_id % 4 + 1 + row_number() over (partition by entity_id order by id) as int) as version_number
      from ch join customer on c_custkey = entity_id where status = 'pending_review'""",
    "review_decisions": f"""with {_HISTORY} select case when status <> 'pending_review' then status when id % 3 = 0 then 'approved' else 'rejected' end as status,
      case when status = 'pending_review' then 7 end as reviewed_by, count(*) as n from ch group by 1, 2""",
    "undo_requests": f"""with {_UNDO} select id, case when can and not newer then ov when field_name = 'created' then 'Cannot undo entity creation via field undo'
      when not can then 'Change is not undoable' else 'A newer change was applied for this field; undo that first' end as answer from u where id % 10 = 3""",
    "undo_values": f"""with {_UNDO}, v as (select entity_id, field_name, min(nv) as value from ch where status = 'rejected' group by 1, 2),
      p as (select entity_id, field_name, arg_max(nv, id) as value from ch where status in ('approved', 'auto_approved') group by 1, 2),
      now as (select entity_id, field_name, coalesce(p.value, v.value) as value from v full join p using (entity_id, field_name)),
      back as (select entity_id, field_name, arg_max(ov, id) as value from u where id % 10 = 3 and can and not newer group by 1, 2)
      select entity_id, field_name, coalesce(back.value, now.value) as value from now full join back using (entity_id, field_name)""",
}
