"""Queries on rules as rows, reasons, cards, labels, places, side outputs, requests and control flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import values
from loomwork.operators import extract, gate, geo, ranking, reasons, rules, runs, shaping
from loomwork.plans import matching, views
from loomwork.plans.views import view
from loomwork.session import spread
from loomwork.sources import robots, schemas


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _rule_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = view(spark, sf_dir, views.SCHEMES)
    return out.withColumns({c: F.split(c, ",") for c in ("categories", "activities")})


_SHOWN = ["scheme_id", "rule_type", "operator", "num_value", "array_join(list_value, ',') as list_value", "str_value", "is_hard"]


def derived_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.derived_rules(_rule_schemes(spark, sf_dir)).selectExpr(*_SHOWN)


def merged_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rules of a third of the schemes on income, and of a quarter on purpose, with what the columns say."""
    derived, k = rules.derived_rules(_rule_schemes(spark, sf_dir)), F.col("scheme_id")
    income = view(spark, sf_dir, views.SCHEMES).where(k % 3 == 0).select("scheme_id", F.lit("income").alias("rule_type"), F.lit(77.0).alias("num_value"), F.lit(None).cast("string").alias("str_value"))
    purpose = view(spark, sf_dir, views.SCHEMES).where(k % 4 == 0).select("scheme_id", F.lit("purpose").alias("rule_type"), F.lit(None).cast("double").alias("num_value"), F.lit("travel").alias("str_value"))
    stored = income.unionByName(purpose).withColumns({"ordinal": F.lit(1), "operator": F.lit("eq"), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "list_value": F.lit(None).cast("array<string>"), "is_hard": F.lit(True)})
    merged = rules.merged_rules(stored.select(derived.columns), derived)
    seeded = schemas.absent(derived, stored, ["scheme_id", "rule_type"]).groupBy("scheme_id").agg(F.count("*").alias("seeded"))
    return merged.join(seeded, "scheme_id", "left").selectExpr(*_SHOWN, "seeded")


def rule_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for every profile's income, category and age rules, and the gaps of those that failed."""
    out = reasons.with_reasons(matching._rule_rows(spark, sf_dir).where("ordinal in (1, 3, 4)"))
    return out.select("profile_id", "ordinal", "reason", F.col("gap.scheme_requires").alias("requires"))


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reasons.with_reasons(matching._rule_rows(spark, sf_dir).where("rule_type in ('income', 'category', 'gender', 'purpose')"))
    line = reasons.suggestion(F.array_sort(F.collect_list(F.struct("ordinal", "passed", "reason"))))
    return out.groupBy("profile_id").agg(line.alias("line"))


def scheme_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with citations, next steps and availability, read back from their JSON."""
    k = F.col("scheme_id")
    s = view(spark, sf_dir, views.SCHEMES).select(F.lit(1).alias("profile_id"), "scheme_id", "interest_rate", "max_loan", F.col("activities").alias("tenure"), F.split("categories", ",").alias("required_documents"))
    cited = s.where(k % 2 == 0).select("scheme_id", F.lit("tenure").alias("field_name"), F.lit("u2").alias("source_url")).unionByName(
        s.where(k % 6 == 0).select("scheme_id", F.lit("max_loan").alias("field_name"), F.lit("u1").alias("source_url")))
    guidance = s.where(k % 5 == 0).select(F.col("scheme_id").alias("id"), "scheme_id", F.array(F.lit("ask first")).alias("steps"))
    out = shaping.cards(shaping.with_guidance(shaping.availability(s), guidance), cited)
    j = lambda p: F.get_json_object("card", p)
    return out.select("scheme_id", j("$.citations[0].field_name").alias("first_cited"), j("$.citations[1].source_url").alias("second_url"), j("$.steps[0]").alias("step"),
        j("$.field_availability.max_loan").alias("has_loan"), j("$.field_availability.required_documents").alias("has_documents"))


def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, views.SCHEMES)
    return s.select("scheme_id", F.array_join(shaping.unavailable({c: F.col(c) for c in ("purpose", "max_loan", "interest_rate")}), ",").alias("missing"))


def patched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial updates: only the fields that a patch sets change, to null as well; ceilings of a source fill live rows."""
    k = F.col("s_suppkey")
    t = _read(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("max_income"), F.col("s_nationkey").alias("source_id"), F.when(k % 4 == 0, "retired").otherwise("active").alias("status"))
    empty = F.create_map().cast("map<string,string>")
    fields = F.when(k % 3 == 0, F.create_map(F.lit("name"), F.lit(None).cast("string"), F.lit("max_income"), F.lit("7.5"))).otherwise(empty)
    patch = _read(spark, sf_dir, "supplier").where(k % 2 == 0).select(k.alias("id"), fields.alias("fields"))
    shared = _read(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("source_id"), (F.col("n_nationkey") * 1.5).alias("max_income"))
    return shaping.known_columns(shaping.shared_ceiling(shaping.updated(t, patch, "id"), shared).withColumn("more", F.lit(1)), t)


def side_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rows with cut messages, and audit rows with JSON details."""
    e = _read(spark, sf_dir, "events")
    failed = e.where("event_type = 'error'").select(F.col("user_id").alias("source_id"), F.lit("u").alias("url"), F.repeat(F.col("props"), 400).alias("message"))
    errors = shaping.error_rows(failed, "fetch_error").select("source_id", F.col("error_type").alias("kind"), F.length("message").cast("string").alias("what"))
    acts = e.where("event_type = 'signup'").select("user_id", F.lit("undo").alias("action"), F.lit("change").alias("entity_type"), F.col("event_id").alias("entity_id"), F.create_map(F.lit("k"), F.col("event_type")).alias("details"))
    audit = shaping.audit_rows(acts, F.lit("now")).select(F.col("user_id").alias("source_id"), F.col("action").alias("kind"), F.concat_ws(":", "entity_id", F.get_json_object("details", "$.k")).alias("what"))
    return errors.unionByName(audit)


def requests_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles and points by the first bound that they break."""
    k = F.col("profile_id")
    p = view(spark, sf_dir, views.PROFILES).withColumns({"age": (k % 110).cast("int"), "annual_family_income": F.col("annual_family_income") - 60000, "project_cost": F.when(k % 9 == 0, 0.0).otherwise(F.col("project_cost"))})
    _, bad = schemas.accepted(p, schemas.profile_problem())
    points = view(spark, sf_dir, views.USERS).select((F.col("lat") * 3).alias("lat"), (F.col("lon") * 2).alias("lon"), (F.col("user_id") % 700).alias("radius_km"))
    _, off = schemas.accepted(points, schemas.point_problem())
    return bad.groupBy("problem").agg(F.count("*").alias("n")).unionByName(off.groupBy("problem").agg(F.count("*").alias("n")))


def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of places in several spellings, resolved against a table of them."""
    places = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.concat("n_name", F.lit(" (old name)")).alias("place"))
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 3 == 0, "State of  ").otherwise(""), F.lit("Nation_"), (k % 40).cast("string"))
    asked = _read(spark, sf_dir, "customer").select(F.when(k % 17 == 0, "").otherwise(name).alias("name")).distinct()
    return shaping.resolved_places(asked, places)


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State and district of address maps: trusted keys first, a district that repeats the state gives way."""
    n = F.col("c_nationkey").cast("string")
    keys = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("state"), n, F.lit("county"), F.when(F.col("c_custkey") % 4 == 0, n).otherwise("C"), F.lit("town"), F.lit("T")))
    state, district = shaping.address_parts(F.coalesce(keys, F.create_map(F.lit("region"), n, F.lit("city"), F.lit("X"))))
    return _read(spark, sf_dir, "customer").select("c_custkey", state.alias("state"), district.alias("district"))


def district_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, district) from JSON of both shapes, and from broken JSON."""
    k = F.col("n_nationkey")
    a = F.concat(F.lit('{"'), "n_name", F.lit('": ["A'), k.cast("string"), F.lit('", "B"]}'))
    b = F.concat(F.lit('{"states": [{"state": "'), "n_name", F.lit('", "districts": ["D'), k.cast("string"), F.lit('"]}]}'))
    return shaping.district_table(_read(spark, sf_dir, "nation").select(F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise("broken").alias("json")))


def coded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.createDataFrame([("SC", "Scheduled Caste"), ("OBC", "Other Backward Class")], "code string, label string")
    out = shaping.coded(view(spark, sf_dir, views.PROFILES), "category", codes)
    target = reasons.gender_label(F.col("gender"), F.col("profile_id") % 2 == 0)
    return out.groupBy("category_label", target.alias("gender_label")).agg(F.count("*").alias("n"))


def first_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of searches in three sources, what the first one that found anything found."""
    k = F.col("c_custkey")
    c = _read(spark, sf_dir, "customer").select(k.alias("request"), F.explode(F.array(*(F.when(k % m != 0, F.struct(F.lit(i).alias("rank"), F.lit(h).alias("hit"))) for i, (m, h) in enumerate([(2, "near"), (3, "region"), (1, "never"), (5, "all")])))).alias("s"))
    return shaping.best_source(c.where("s is not null").select("request", "s.*"), "request", "rank").select("request", "hit")


def catalogue_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemes by purpose and substring, the sorted purposes, mappable partners with the circle's radius, and whether any run is busy."""
    s = view(spark, sf_dir, views.SCHEMES)
    some = shaping.filtered(s, F.col("name"), "SUPPLIER#0000000", "Business", "purpose").agg(F.count("*").alias("n")).select(F.lit("filtered").alias("what"), F.col("n").cast("double"))
    kinds = shaping.purposes(s).agg(F.array_join(F.collect_list("purpose"), ",").alias("p")).select(F.concat(F.lit("purposes "), "p").alias("what"), F.lit(0.0).alias("n"))
    at = shaping.mappable(view(spark, sf_dir, views.PARTNERS).withColumnsRenamed({"p_lat": "latitude", "p_lon": "longitude"})).agg(shaping.circle_metres(F.count("*")).alias("n")).select(F.lit("mappable").alias("what"), F.col("n").cast("double"))
    busy = shaping.any_busy(view(spark, sf_dir, views.RUNS)).select(F.lit("busy").alias("what"), F.col("busy").cast("double").alias("n"))
    return some.unionByName(kinds).unionByName(at).unionByName(busy)


def change_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many changes each filter lets through; only the first that is set applies."""
    rows = view(spark, sf_dir, views.CHANGES).withColumn("scraping_run_id", F.when(F.col("id") % 3 != 0, F.col("id") % 10))
    asked = {"run": {"run_id": 4, "status": "rejected"}, "unlinked": {"unlinked": True, "status": "rejected"}, "unlinked undoable": {"unlinked": True, "undoable": True}, "undoable": {"undoable": True}, "status": {"status": "rejected"}, "all": {}}
    out = None
    for name, how in asked.items():
        n = runs.change_filter(rows, **how).agg(F.count("*").alias("n")).select(F.lit(name).alias("asked"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of what administrators list: waiting changes by id, versions of an entity by number, newest first, partners by id."""
    rows = view(spark, sf_dir, views.CHANGES)
    waiting = runs.waiting_changes(rows).limit(5).select(F.lit("waiting").alias("listed"), "id")
    from loomwork.operators import changes

    versions = runs.versions_listed(changes.versions(rows.where("entity_id = 7"))).limit(5).select(F.lit("versions").alias("listed"), "id")
    partners = runs.by_id(view(spark, sf_dir, views.PARTNERS), "partner_id").limit(5).select(F.lit("partners").alias("listed"), F.col("partner_id").alias("id"))
    return waiting.unionByName(versions).unionByName(partners)


def mapped_or_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners mapped to one scheme, and the listing for a scheme without a mapping."""
    k = F.col("s_suppkey")
    partners = _read(spark, sf_dir, "supplier").select(k.alias("partner_id"), F.when(k % 3 == 0, "active").when(k % 3 == 1, "authorized").otherwise("closed").alias("status"))
    mapping = _read(spark, sf_dir, "supplier").select(k.alias("partner_id"), F.lit(1).alias("scheme_id"), F.when(k % 5 == 0, "eligible").otherwise("rejected").alias("eligibility_status"))
    one, two = (geo.mapped_partners(partners, mapping, i).select(F.lit(i).alias("scheme_id"), "partner_id", "mapped") for i in (1, 2))
    return one.unionByName(two)


def loose_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of loose JSON: a list or its only element, a key or its other name, a dotted path with a fallback, truth as the sender means it."""
    k = F.col("event_id")
    j = F.concat(F.lit('{"a": '), F.when(k % 3 == 0, '["x", "y"]').when(k % 3 == 1, '"z"').otherwise("null"), F.lit(', "'), F.when(k % 2 == 0, "categories").otherwise("category"), F.lit('": "c", "deep": {"er": '), (k % 4).cast("string"), F.lit("}}"))
    e = _read(spark, sf_dir, "events").select("event_id", j.alias("j"))
    return e.select("event_id", F.array_join(values.listed(F.get_json_object("j", "$.a")), ",").alias("listed"), values.either("j", "categories", "category").alias("one"),
        values.dotted("j", "deep.er", "?").alias("deep"), values.dotted("j", "deep.none", "?").alias("none"), values.truthy(F.get_json_object("j", "$.deep.er")).alias("truth"))


def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots.txt against addresses, and the verdict with the answer of the home page."""
    k = F.col("page_id")
    text = F.when(k % 2 == 0, F.lit("User-agent: *\nDisallow: /private\n")).otherwise(F.lit("User-agent: *\nDisallow:\n"))
    url = F.concat(F.lit("http://a.b/"), F.when(k % 3 == 0, "private/").otherwise("open/"), k.cast("string"))
    s = _read(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.when(k % 5 == 0, 404).when(k % 7 == 0, 500).otherwise(200).alias("robots_status"), text.alias("robots_text"))
    out = robots.with_robots(s, "bot")
    return out.select("page_id", "robots_allowed", gate.crawl_verdict(F.col("robots_allowed"), F.when(k % 11 == 0, 403).when(k % 13 != 0, 200)).alias("verdict"))


_NUMBERED_TEXT = (
    "concat('1\n', case when p_partkey % 2 = 0 then 'Term Loan' else 'Educational Loan Scheme (ELS)' end, '\nunit cost up to Rs. ', cast(1 + p_partkey % 9 as varchar(9)), ' lakh. NSFDC shall charge 3% from the SCAs"
    " and SCAs shall charge ', cast(4 + p_partkey % 5 as varchar(9)), '% from the Beneficiaries. Maximum Loan Limit up to Rs. ', cast(2 + p_partkey % 7 as varchar(9)), ' lakh. Repayment period ', cast(3 + p_partkey % 4 as varchar(9)), ' years\n')"
)


def numbered_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemes of numbered headings: what the beneficiary pays, the largest loan, the term."""
    docs = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit("http://nsfdc.example.com/schemes").alias("url"), F.expr(_NUMBERED_TEXT.replace("\n", "\\n")).alias("text"))
    return extract.numbered_schemes(spread(docs)).select("doc_id", "name", "max_loan", "interest_rate", "tenure", "purpose", "scheme_type")


def shared_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 3 == 0, "Eligibility: ").otherwise("Terms: "), F.when(k % 2 == 0, F.concat(F.lit("annual family income should not exceed Rs. "), (1 + k % 8).cast("string"), F.lit(" lakh"))).otherwise("none"),
        F.when(k % 5 == 0, ". Ask the State Channelizing Agencies").otherwise(""))
    out = extract.shared_eligibility(_read(spark, sf_dir, "part").select(k.alias("doc_id"), text.alias("text")))
    return out.select("doc_id", "max_income", F.array_join("categories", ",").alias("categories"), "application_process")


def recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of recommendations with the number of rows in full detail and in summary."""
    found = matching.best(matching._profiles(spark, sf_dir), matching._schemes(spark, sf_dir), 10)
    return ranking.detailed(found).groupBy("rank", "detail_level").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        derived_rules, merged_rules, rule_reasons, suggestions, scheme_cards, missing_fields, patched_rows, side_outputs, requests_checked, place_names, addresses,
        district_rows, coded_labels, first_sources, catalogue_filters, change_filters, ordered_lists, mapped_or_listed, loose_json, robots_allowed, numbered_listings,
        shared_eligibility, recommended,
    )
}

_DERIVED = f"""s as (select *, coalesce(purpose, case when scheme_type like '%education%' then 'education' when scheme_type like '%term_loan%' then 'business' end) as meant from {views.sql(views.SCHEMES)}),
d as (select scheme_id, 'income' as rule_type, 'lte' as operator, max_income as num_value, cast(null as varchar) as list_value, cast(null as varchar) as str_value, true as is_hard from s where max_income is not null
  union all select scheme_id, 'income', 'gte', min_income, null, null, true from s where min_income is not null
  union all select scheme_id, 'loan_amount', 'lte', max_loan, null, null, true from s where max_loan is not null
  union all select scheme_id, 'loan_amount', 'gte', min_loan, null, null, true from s where min_loan is not null
  union all select scheme_id, 'category', 'in', null, categories, null, true from s where categories is not null
  union all select scheme_id, 'project_type', 'intersects', null, activities, null, false from s where activities is not null
  union all select scheme_id, 'purpose', 'purpose_match', null, null, meant, true from s where meant is not null
  union all select scheme_id, 'gender', 'gender_match', null, null, target_gender, true from s where target_gender in ('male', 'female'))"""
_MONEY = "'₹' || format('{{:,}}', cast(round_even({0}, 0) as bigint))"
_REASONS = f"""p as {views.sql(views.PROFILES)},
y as (select profile_id, 1 as ordinal, case when annual_family_income is null then 'This information (income) is required to confirm eligibility.' when annual_family_income <= 300000 then 'Your family income is within the required limit.'
      else 'Your annual family income (' || {_MONEY.format('annual_family_income')} || ') is above the scheme limit (₹300,000). You currently do not meet this income criterion.' end as reason,
    case when annual_family_income > 300000 then '300000.0' end as requires, annual_family_income <= 300000 as passed from p
  union all select profile_id, 3, case when category is null then 'This information (category) is required to confirm eligibility.' when category in ('SC', 'ST') then 'Your category matches the published beneficiary requirement.'
      else 'Your category (' || category || ') is not in the allowed beneficiary categories (SC,  st ).' end, case when category not in ('SC', 'ST') then 'SC,  st ' end, category in ('SC', 'ST') from p
  union all select profile_id, 4, case when age between 21 and 45 then 'Your age meets the published age condition.' else 'Your age (' || age || ') does not meet the published age condition for this scheme.' end, null, age between 21 and 45 from p
  union all select profile_id, 5, case when lower(purpose) in ('business', 'self-employment', 'agriculture') then 'Your purpose matches the scheme purpose.' else '-' end, null, lower(purpose) in ('business', 'self-employment', 'agriculture') from p
  union all select profile_id, 6, case when gender in ('female', 'prefer_not_to_say') then 'This scheme matches your gender eligibility.' else '-' end, null, gender in ('female', 'prefer_not_to_say') from p)"""
_FILTERS = f"ch as (select *, case when id % 3 <> 0 then id % 10 end as run, status in ('approved', 'auto_approved') and field_name <> 'created' as can from {views.sql(views.CHANGES)})"

ORACLE_SQL = {
    "derived_rules": f"with {_DERIVED} select * from d",
    "merged_rules": f"""with {_DERIVED}, t as (select scheme_id, 'income' as rule_type, 'eq' as operator, 77.0::double as num_value, null as list_value, null as str_value, true as is_hard from s where scheme_id % 3 = 0
        union all select scheme_id, 'purpose', 'eq', null, null, 'travel', true from s where scheme_id % 4 = 0),
      k as (select * from t where rule_type <> 'purpose' or scheme_id not in (select scheme_id from d where rule_type = 'purpose')),
      a as (select * from d where rule_type = 'purpose' or (scheme_id, rule_type) not in (select (scheme_id, rule_type) from t)),
      n as (select scheme_id, count(*) as seeded from d where (scheme_id, rule_type) not in (select (scheme_id, rule_type) from t) group by 1)
      select x.*, seeded from (select * from k union all select * from a) x left join n using (scheme_id)""",
    "rule_reasons": f"with {_REASONS} select profile_id, ordinal, reason, requires from y where ordinal in (1, 3, 4)",
    "suggestions": f"""with {_REASONS}, g as (select *, row_number() over (partition by profile_id order by ordinal) as r from y where passed and ordinal in (1, 3, 5, 6)),
      l as (select profile_id, string_agg(reason, '; ' order by ordinal) as t from g where r <= 3 group by 1)
      select profile_id, coalesce(' Key matches: ' || t || '.', '') as line from p left join l using (profile_id)""",
    "scheme_cards": f"""select scheme_id, case when scheme_id % 6 = 0 then 'max_loan' when scheme_id % 2 = 0 then 'tenure' end as first_cited, case when scheme_id % 6 = 0 then 'u2' end as second_url,
      case when scheme_id % 5 = 0 then 'ask first' else 'Confirm your eligibility against the official scheme page.' end as step, case when max_loan is null then 'false' else 'true' end as has_loan,
      case when categories is null then 'false' else 'true' end as has_documents from {views.sql(views.SCHEMES)}""",
    "missing_fields": f"""select scheme_id, concat_ws(',', case when purpose is null then 'purpose' end, case when max_loan is null then 'max_loan' end, case when interest_rate is null then 'interest_rate' end) as missing
      from {views.sql(views.SCHEMES)}""",
    "patched_rows": """select s_suppkey as id, case when s_suppkey % 6 = 0 then null else s_name end as name,
      case when s_suppkey % 4 <> 0 and s_nationkey % 3 = 0 then s_nationkey * 1.5 when s_suppkey % 6 = 0 then 7.5 else s_acctbal end::double as max_income, s_nationkey as source_id,
      case when s_suppkey % 4 = 0 then 'retired' else 'active' end as status from supplier""",
    "side_outputs": """select user_id as source_id, 'fetch_error' as kind, cast(least(4000, length(props) * 400) as varchar) as what from events where event_type = 'error'
      union all select user_id, 'undo', event_id || ':signup' from events where event_type = 'signup'""",
    "requests_checked": f"""with p as (select *, profile_id % 110 as years, annual_family_income - 60000 as income, case when profile_id % 9 = 0 then 0 else project_cost end as cost from {views.sql(views.PROFILES)}),
      a as (select case when years not between 18 and 100 then 'age' when income < 0 then 'annual_family_income' when cost <= 0 then 'project_cost' when loan_required <= 0 then 'loan_required' end as problem from p),
      b as (select case when abs(lat * 3) > 90 then 'latitude' when abs(lon * 2) > 180 then 'longitude' when user_id % 700 not between 1 and 500 then 'radius_km' end as problem from {views.sql(views.USERS)})
      select problem, count(*) as n from a where problem is not null group by 1 union all select problem, count(*) from b where problem is not null group by 1""",
    "place_names": """with a as (select distinct case when c_custkey % 17 = 0 then '' else case when c_custkey % 3 = 0 then 'State of  ' else '' end || 'Nation_' || c_custkey % 40 end as name from customer),
      m as (select name, arg_min(n_name || ' (old name)', (lower(n_name || ' (old name)') <> low, n_nationkey)) as place
        from (select name, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) as low from a where name <> '') join nation on contains(lower(n_name), low) or contains(low, lower(n_name)) group by 1)
      select name, place from a left join m using (name)""",
    "addresses": """select c_custkey, cast(c_nationkey as varchar) as state, case when c_custkey % 4 = 0 then 'T' when c_custkey % 2 = 0 then 'C' else 'X' end as district from customer""",
    "district_rows": """select n_name as state, unnest(['A' || n_nationkey, 'B']) as district from nation where n_nationkey % 3 = 0 union all select n_name, 'D' || n_nationkey from nation where n_nationkey % 3 = 1""",
    "coded_labels": f"""select case category when 'SC' then 'Scheduled Caste' when 'OBC' then 'Other Backward Class' else category end as category_label,
      case when profile_id % 2 = 0 then case gender when 'male' then 'पुरुष' when 'female' then 'महिला' else 'दोनों' end else case gender when 'male' then 'Male' when 'female' then 'Female' else 'Both' end end as gender_label,
      count(*) as n from {views.sql(views.PROFILES)} group by 1, 2""",
    "first_sources": "select c_custkey as request, case when c_custkey % 2 <> 0 then 'near' when c_custkey % 3 <> 0 then 'region' else 'all' end as hit from customer where c_custkey % 30 <> 0",
    "catalogue_filters": f"""select 'filtered' as what, cast(count(*) as double) as n from {views.sql(views.SCHEMES)} where contains(lower(name), 'supplier#0000000') and purpose = 'business'
      union all select 'purposes ' || string_agg(purpose, ',' order by purpose), 0 from (select distinct purpose from {views.sql(views.SCHEMES)} where purpose is not null)
      union all select 'mappable', 1000 * count(*) from {views.sql(views.PARTNERS)} where p_lat is not null union all select 'busy', cast(bool_or(status in ('queued', 'running')) as int) from {views.sql(views.RUNS)}""",
    "change_filters": f"""with {_FILTERS} select 'run' as asked, count(*) as n from ch where run = 4 union all select 'unlinked', count(*) from ch where run is null union all select 'unlinked undoable', count(*) from ch where run is null and can
      union all select 'undoable', count(*) from ch where can union all select 'status', count(*) from ch where status = 'rejected' union all select 'all', count(*) from ch""",
    "ordered_lists": f"""with ch as (select * from {views.sql(views.CHANGES)}) select * from (select 'waiting' as listed, id from ch where status = 'pending_review' order by id limit 5)
      union all select * from (select 'versions', id from ch where entity_id = 7 order by effective_from desc, id desc limit 5) union all select * from (select 'partners', s_suppkey from supplier order by 2 limit 5)""",
    "mapped_or_listed": """select 1 as scheme_id, s_suppkey as partner_id, true as mapped from supplier where s_suppkey % 5 = 0 and s_suppkey % 3 < 2 union all select 2, s_suppkey, false from supplier where s_suppkey % 3 = 0""",
    "loose_json": """select event_id, case event_id % 3 when 0 then 'x,y' when 1 then 'z' else '' end as listed, 'c' as one, cast(event_id % 4 as varchar) as deep, '?' as none, event_id % 4 <> 0 as truth from events""",
    "robots_allowed": """with r as (select page_id, case when page_id % 5 = 0 then true when page_id % 7 = 0 then null else page_id % 2 <> 0 or page_id % 3 <> 0 end as robots_allowed,
        case when page_id % 11 = 0 then 403 when page_id % 13 <> 0 then 200 end as http from pages)
      select page_id, robots_allowed, case when not robots_allowed or http = 403 then 'blocked' when robots_allowed and http < 400 then 'allowed' else 'uncertain' end as verdict from r""",
    "numbered_listings": """select p_partkey as doc_id, case when p_partkey % 2 = 0 then 'Term Loan' else 'Educational Loan Scheme (ELS)' end as name, (2 + p_partkey % 7) * 100000.0::double as max_loan,
      cast(4 + p_partkey % 5 as double) as interest_rate, cast((3 + p_partkey % 4) * 12 as int) as tenure, case when p_partkey % 2 = 0 then 'business' else 'education' end as purpose,
      case when p_partkey % 2 = 0 then 'term_loan' else 'educational_loan' end as scheme_type from part""",
    "shared_eligibility": """select p_partkey as doc_id, case when p_partkey % 2 = 0 then (1 + p_partkey % 8) * 100000.0::double end as max_income, 'SC' as categories,
      case when p_partkey % 5 = 0 then 'Apply through the concerned State Channelizing Agencies (SCAs) or Channelizing Agencies (CAs). NSFDC does not entertain direct applications from beneficiaries.' end as application_process
      from part where p_partkey % 3 = 0 or p_partkey % 2 = 0""",
    "recommended": f"""with {matching._PAIRS}, n as (select *, row_number() over (partition by profile_id order by score desc, lower(name), scheme_id) as rank from g where hard_fails = 0)
      select rank, case when rank <= 3 then 'full' else 'summary' end as detail_level, count(*) as n from n where rank <= 10 group by 1, 2""",
}
