"""Queries on all that a promoted batch leads to: addresses, waiting changes, citations, rules, links of partners; and chains of undos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import changes, promotion
from loomwork.plans import promotion as batches
from loomwork.plans import views
from loomwork.plans.views import view

_URL = "case {0} % 4 when 0 then null when 1 then '' else concat('new-', cast({0} as varchar(9))) end"
_WAITING = (
    "supplier",
    [
        "s_suppkey as id",
        "s_suppkey - s_suppkey % 3 as entity_id",
        "case s_suppkey % 3 when 0 then 'max_loan' when 1 then 'name' else 'valid_to' end as field_name",
        "case s_suppkey % 5 when 0 then 'detected' when 1 then 'approved' when 2 then 'conflict' else 'pending_review' end as status",
        "case when s_suppkey % 2 = 0 then 'seen' else null end as notes",
    ],
)
_CITED = ("supplier", ["s_suppkey as entity_id", "case s_suppkey % 3 when 0 then 'max_loan' when 1 then 'name' else 'tenure' end as field_name", "s_nationkey as source_id", "'old' as source_url"])
_RULES = ("supplier", ["s_suppkey as scheme_id", "'income' as rule_type", "'lte' as operator", "cast(1 as double) as num_value"])
_LINKS = ("supplier", ["s_suppkey as partner_id", "s_suppkey as scheme_id", "'stored' as eligibility_status", "s_nationkey as source_id"])
_LINKED = "case s_suppkey % 3 when 0 then concat('loan-', cast(s_suppkey as varchar(9))) when 1 then 'loan-7' else null end as linked_scheme_key"


def _flow(spark: SparkSession, sf_dir: str) -> promotion.Promotion:
    schemes = view(spark, sf_dir, batches.SCHEMES).unionByName(view(spark, sf_dir, batches.VARIANTS).where("id % 6 = 1000000 % 6"))
    schemes = schemes.withColumns({"last_verified": F.lit(None).cast("timestamp"), "source_url": F.lit("u-old")})
    staging = view(spark, sf_dir, batches.STAGING).where("staging_id % 3 < 2 and good").drop("good").withColumn("source_url", F.expr(_URL.format("staging_id")))
    cited = view(spark, sf_dir, _CITED).withColumn("last_verified", F.lit(None).cast("timestamp"))
    return promotion.promote(staging, schemes, batches.AS_OF, view(spark, sf_dir, _WAITING), cited, view(spark, sf_dir, _RULES).where("scheme_id % 5 < 2"))


def promoted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark, sf_dir).schemes.select("canonical_key", "source_url", "current_version")


def promoted_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark, sf_dir).waiting


def promoted_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = _flow(spark, sf_dir)
    keys = flow.schemes.select(F.col("id").alias("entity_id"), "canonical_key")
    return flow.citations.join(keys, "entity_id").select("canonical_key", "field_name", "source_id", "source_url", F.col("last_verified").isNotNull().alias("verified"))


def promoted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = _flow(spark, sf_dir)
    keys = flow.schemes.select(F.col("id").alias("scheme_id"), "canonical_key")
    return flow.rules.join(keys, "scheme_id").select("canonical_key", "rule_type", "operator", "num_value")


def partner_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a batch of partners, by their keys, on top of those that are stored."""
    staged = view(spark, sf_dir, ("supplier", [*batches._PARTNER_BATCH[1], _LINKED]))
    old = view(spark, sf_dir, batches._PARTNERS).withColumns({"last_verified": F.lit(None).cast("timestamp"), "source_id": F.lit(3)})
    now, _ = promotion.promoted_partners(staged.drop("linked_scheme_key"), old, batches.AS_OF)
    links = promotion.partner_links(staged, now, view(spark, sf_dir, batches.SCHEMES), view(spark, sf_dir, _LINKS).where("partner_id % 6 = 3").withColumn("source_id", F.col("source_id").cast("int")))
    return links.join(now.select(F.col("id").alias("partner_id"), "canonical_key"), "partner_id").select("canonical_key", "scheme_id", "eligibility_status", "source_id")


def undo_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values after undoing two of three changes, the newest first; a field's chain ends at the newest change that was not asked for."""
    rows, _ = batches._history(spark, sf_dir)
    _, back, _ = promotion.undo_each(rows, rows.where("id % 3 <> 1").select("id"), 7)
    last = changes.applied(rows.limit(0).selectExpr("entity_id", "field_name", "new_value as value"), back.drop("id").withColumnRenamed("step", "id"))
    return last.join(back.groupBy("entity_id", "field_name").agg(F.count("*").alias("undone")), ["entity_id", "field_name"])


QUERIES = {f.__name__: f for f in (promoted_urls, promoted_waiting, promoted_citations, promoted_rules, partner_links, undo_chains)}

_FLOW = f"""{batches._PROMOTED},
f as (select a.id, a.source_id as own, a.canonical_key, a.touched, a.current_version, m.staging_id, m.max_loan, m.interest_rate, m.source_id, a.max_loan as now_loan,
    case when m.staging_id is null then 'u-old' else coalesce(nullif({_URL.format('m.staging_id')}, ''), 'u-old') end as url from a left join m on m.sid = a.id),
g as (select entity_key as canonical_key, staging_id, max_loan, interest_rate, source_id, nullif({_URL.format('staging_id')}, '') as url, {_URL.format('staging_id')} as raw from m where sid is null)"""

ORACLE_SQL = {
    "promoted_urls": f"with {_FLOW} select canonical_key, url as source_url, current_version from f union all select canonical_key, raw, 1 from g",
    "promoted_waiting": f"""with {_FLOW}, h as (select distinct sid, field_name from ch where field_name not in ('name', 'canonical_key')),
      wt as (select w.*, h.sid is not null and status in ('detected', 'conflict', 'pending_review') as hit from {views.sql(_WAITING)} w left join h on sid = entity_id and h.field_name = w.field_name)
      select id, entity_id, field_name, case when hit then 'superseded' else status end as status,
        case when not hit then notes when notes is null then 'superseded by auto-applied crawl' else notes || ' | superseded by auto-applied crawl' end as notes from wt""",
    "promoted_citations": f"""with {_FLOW}, tc as (select id, canonical_key, max_loan, interest_rate, source_id, url from f where touched
        union all select null, canonical_key, max_loan, interest_rate, source_id, url from g where url is not null),
      c as (select id, canonical_key, 'name' as field_name, source_id, url from tc union all select id, canonical_key, 'max_loan', source_id, url from tc where max_loan is not null
        union all select id, canonical_key, 'interest_rate', source_id, url from tc where interest_rate is not null),
      o as (select a.canonical_key, x.field_name, x.source_id, x.source_url from {views.sql(_CITED)} x join a on a.id = x.entity_id
        left join c on c.id = x.entity_id and c.field_name = x.field_name where c.id is null)
      select canonical_key, field_name, source_id, url as source_url, true as verified from c union all select *, false from o""",
    "promoted_rules": f"""with {_FLOW}, r0 as (select * from {views.sql(_RULES)} where scheme_id % 5 < 2)
      select canonical_key, rule_type, operator, num_value from r0 join f on f.id = scheme_id
      union all select canonical_key, 'loan_amount', 'lte', now_loan from f where touched and id not in (select scheme_id from r0) and now_loan is not null
      union all select canonical_key, 'loan_amount', 'lte', max_loan from g where max_loan is not null""",
    "partner_links": f"""with b as (select *, {_LINKED} from (select s.s_suppkey, x.* from supplier s join {views.sql(batches._PARTNER_BATCH)} x on x.staging_id = s.s_suppkey)),
      o as {views.sql(batches._PARTNERS)}, l as (select * from {views.sql(_LINKS)} where partner_id % 6 = 3),
      x as (select b.entity_key, o.id as partner_id, s.id as scheme_id from b left join o on o.canonical_key = b.entity_key join {views.sql(batches.SCHEMES)} s on s.canonical_key = b.linked_scheme_key)
      select 'p-' || partner_id as canonical_key, scheme_id, eligibility_status, cast(source_id as int) as source_id from l
      union all select entity_key, scheme_id, 'eligible', case when partner_id is not null then 3 end from x where not exists (select 1 from l where l.partner_id = x.partner_id and l.scheme_id = x.scheme_id)""",
    "undo_chains": f"""with {batches._HISTORY}, c as (select *, status in ('approved', 'auto_approved') and field_name <> 'created' as can from ch),
      u as (select *, coalesce(max(case when can and id % 3 = 1 then id end) over (partition by entity_id, field_name), -1) as kept from c)
      select entity_id, field_name, arg_min(ov, id) as value, count(*) as undone from u where can and id % 3 <> 1 and id > kept group by 1, 2""",
}
