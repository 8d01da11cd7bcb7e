"""Queries on scalars: instalments, schedules, freshness, keys, hashes, amounts, similarity, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import dates, numbers, text
from loomwork.operators import finance, intent, search
from loomwork.plans import views
from loomwork.plans.views import view

AS_OF = "2001-08-15 00:00:00"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def emi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finance.with_emi(view(spark, sf_dir, views.LOANS)).select("loan_id", "emi", "total_interest", "total_repayment", "warning", "error")


def emi_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finance.schedule(view(spark, sf_dir, views.LOANS), "loan_id")


def emi_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = finance.schedule(view(spark, sf_dir, views.LOANS), "loan_id")
    return rows.groupBy("loan_id").agg(F.count("*").alias("periods"), F.round(F.sum("interest"), 0).alias("interest"), F.max("period").alias("last_period"))


def freshness_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate").cast("timestamp"))
    return _read(spark, sf_dir, "orders").groupBy(dates.freshness(ts, dates.at(AS_OF)).alias("state")).agg(F.count("*").alias("n"))


def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", text.canonical_key(F.col("text")).alias("key"))


def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat_ws("-", F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.element_at(F.array(*(F.lit(x) for x in ("men", "for-women", "women-for-men", "x"))), (F.col("p_partkey") % 4 + 1).cast("int")), F.lit("loan"))
    return _read(spark, sf_dir, "part").select("p_partkey", text.entity_key(raw).alias("key"))


def squeezed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.squeezed(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.length(t).alias("n"), text.content_hash(t).alias("hash"))


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    unit = F.element_at(F.array(*(F.lit(x) for x in (" lakh", " crore", "", " rupees"))), (k % 4 + 1).cast("int"))
    said = F.concat(F.lit("Rs. "), F.col("p_size").cast("string"), F.lit("."), (k % 10).cast("string"), unit)
    rate = F.concat(F.lit("at "), F.col("p_size").cast("string"), F.when(k % 2 == 0, " % a year").otherwise(" Percent"))
    time = F.concat(F.lit("within "), F.element_at(F.array(*(F.lit(x) for x in ("three years", "18 months", "4 years", "36", "twelve month", "soon"))), (k % 6 + 1).cast("int")))
    return _read(spark, sf_dir, "part").select(
        "p_partkey", F.round(text.indian_amount(said), 2).alias("amount"), text.percent(rate).alias("percent"), text.months(time).alias("months"),
        F.round(intent.amount(F.concat(F.lit("need "), said)), 2).alias("asked"),
    )


def money_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(
        "p_partkey", text.rupees_whole(F.col("p_retailprice") * 1000).alias("label"), text.indian_grouping(F.col("p_retailprice") * 1000).alias("grouped")
    )


def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m, y = F.col("o_orderkey") % 33, F.col("o_orderkey") % 14, F.lit(1995) + F.col("o_orderkey") % 7
    raw = F.concat_ws("/", d.cast("string"), m.cast("string"), y.cast("string"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", dates.parsed_date(raw).alias("day"))


def timeline_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    kind = F.when(k % 5 == 0, "lifetime")
    start, end = F.when(k % 3 != 0, day), F.when(k % 4 != 0, day)
    return _read(spark, sf_dir, "orders").select("o_orderkey", dates.timeline_label(kind, start, end).alias("label"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar of ten exemplars, the first vector of each label, for every vector."""
    rows = _read(spark, sf_dir, "embeddings")
    exemplars = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("exemplar")).withColumn("ord", F.col("label"))
    best = intent.best_exemplar(rows.select("vec_id", "embedding"), "vec_id", "embedding", exemplars, least=-1.0)
    return best.select("vec_id", "similarity")


def js_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").groupBy(numbers.js_round(F.col("l_quantity") / 4).cast("bigint").alias("quarter")).agg(F.count("*").alias("n"))


_QUERIES = [(1, "the ghost steel"), (2, "green loan scheme 7"), (3, "small blue"), (4, "Part 12"), (5, "red")]


def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemes = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("blob"))
    asked = spark.createDataFrame(_QUERIES, "query_id int, q string")
    return search.search(asked, schemes).select("query_id", "id", "score", "rank")


def search_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name and size of a part as a query, against all parts: postings of grams, no nested loop."""
    part = _read(spark, sf_dir, "part")
    schemes = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_size").alias("name"), F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_size").alias("blob"))
    asked = part.select(F.concat_ws(" ", "p_name", F.lit("the"), "p_size").alias("q")).distinct()
    return search.search(asked.withColumn("query_id", F.col("q")), schemes).select("query_id", "id", "score", "rank")


def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = search.query_tokens(F.col("text"))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(t).cast("bigint").alias("n"), F.array_join(F.slice(t, 1, 5), " ").alias("head"))


def intent_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intent.parsed(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return out.select("conv_id", "turn", "purpose", "project_type", "category", "loan_required", "n_fields", "confidence")


def _any(words: list[str]) -> str:
    def one(w: str) -> str:
        if len(w) <= 3 and w.isascii():
            return f"regexp_matches(l, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')"
        return f"contains(l, '{w}') or contains(o, '{w}')"

    return "(" + " or ".join(one(w) for w in words) + ")"


def _case(labels: dict[str, list[str]]) -> str:
    return "case " + " ".join(f"when {_any(w)} then '{k}'" for k, w in labels.items()) + " end"


_EMI = f"""
l as (
  select *, case frequency when 'monthly' then 12 when 'quarterly' then 4 else 1 end as ppy,
    case when principal <= 0 then 'Loan amount must be positive' when tenure <= 0 then 'Tenure must be positive'
      when moratorium < 0 then 'Moratorium cannot be negative' when moratorium >= tenure then 'Moratorium must be less than tenure' end as error
  from {views.sql(views.LOANS)}
), m as (select *, greatest(1, cast(round_even((tenure - moratorium) * ppy / 12.0, 0) as int)) as n, rate / 100.0::double / ppy as r from l),
e as (select *, case when r = 0 then principal / n else principal * r * pow(1 + r, n) / (pow(1 + r, n) - 1) end as each from m)
"""
_SCHEDULE = f"""{_EMI}, k as (select loan_id, principal as p, n, r, each as e, unnest(range(1, n + 1)) as period from e where error is null and rate is not null),
b as (select *, greatest(0, case when r = 0 then p - e * (period - 1) else p * pow(1 + r, period - 1) - e * (pow(1 + r, period - 1) - 1) / r end) as before from k),
i as (select *, before * r as interest, least(e - before * r, before) as part from b)
"""
_SQL_QUERIES = ", ".join(f"({i}, '{q}')" for i, q in _QUERIES)
_STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
_TOKENS = "list_filter(regexp_split_to_array(lower(trim({0}, ' ')), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '' and t not in (" + _STOP + "))"

QUERIES = {
    f.__name__: f
    for f in (
        emi, emi_schedule, emi_totals, freshness_buckets, canonical_keys, entity_keys, squeezed_texts, amounts, money_labels, parsed_dates,
        timeline_labels, cosine_topk, js_rounding, fuzzy_search, search_by_table, search_tokens, intent_parse,
    )
}

_SEARCHED = """      a as (select query_id, id, name, low, t, list_filter(t, lambda x: regexp_full_match(x, '[0-9]{1,3}'))[1] as num, array_to_string(t, ' ') as phrase,
          len(list_filter(t, lambda x: contains(low, x))) as hits, len(list_filter(t, lambda x: contains(blob, x))) as bhits, len(t) as n,
          list_filter(t, lambda x: not regexp_full_match(x, '[0-9]+') and x not in ('scheme', 'samajik', 'nyay', 'yojana', 'loan')) as act from p cross join q),
      b as (select *, len(list_filter(act, lambda x: contains(low, x))) as acted,
          regexp_replace(regexp_replace(low, '\\b(men|women|male|female)\\b', ' ', 'g'), '\\s+', ' ', 'g') as compact from a
          where not (num is not null and not contains(low, num)) and not (hits < least(2, n) and bhits < n)),
      c as (select query_id, id, name, cast(case when contains(low, phrase) then 100 else 0 end + case when contains(compact, phrase) then 90 else 0 end
          + floor(hits::double / n * 50 + 0.5) + floor(bhits::double / n * 8 + 0.5)
          + case when num is not null and regexp_matches(low, 'scheme\\s*0*' || cast(cast(num as int) as varchar) || '\\b') then 30 else 0 end
          + case when len(act) = 0 then 0 when acted = len(act) then 45 when acted = 0 then -40 else acted * 8 end
          - case when hits::double / n < 0.6 then 50 else 0 end as bigint) as score from b),
      d as (select *, max(score) over (partition by query_id) as best from c where score >= 60),
      e as (select *, row_number() over (partition by query_id order by score desc, name, id) as rank from d where score >= best - 25)
      select query_id, id, score, rank from e where rank <= 5"""

ORACLE_SQL = {
    "emi": f"""with {_EMI} select loan_id, case when error is null and rate is not null then round(each, 2) end as emi,
      case when error is null and rate is not null then round(each * n - principal, 2) + 0.0 end as total_interest,
      case when error is null and rate is not null then round(principal + (each * n - principal), 2) end as total_repayment,
      case when error is null and rate is null then 'rate_unavailable' when error is null and moratorium > 0 then 'moratorium_interest_unknown' end as warning, error from e""",
    "emi_schedule": f"""with {_SCHEDULE} select loan_id, period, round(part + interest, 2) as emi, round(part, 2) as principal, round(interest, 2) as interest,
      round(greatest(0, before - part), 2) as balance from i""",
    "emi_totals": f"""with {_SCHEDULE} select loan_id, count(*) as periods, round(sum(round(interest, 2)), 0) as interest, max(period) as last_period from i group by 1""",
    "freshness_buckets": f"""with t as (select case when o_orderkey % 13 <> 0 then o_orderdate end as ts from orders)
      select case when ts is null then 'Unknown' when epoch_us(timestamp '{AS_OF}') - epoch_us(ts) <= 7 * 86400000000 then 'Fresh'
        when epoch_us(timestamp '{AS_OF}') - epoch_us(ts) <= 30 * 86400000000 then 'Aging' else 'Stale' end as state, count(*) as n from t group by 1""",
    "canonical_keys": """select doc_id, substr(trim(regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '[^a-z0-9ऀ-ॿ]+', '-', 'g'), '-'), 1, 480) as key
      from documents""",
    "entity_keys": """with r as (select p_partkey, concat_ws('-', replace(lower(p_name), ' ', '-'), (['men', 'for-women', 'women-for-men', 'x'])[p_partkey % 4 + 1], 'loan') as k from part),
      a as (select p_partkey, list_filter(string_split(k, '-'), lambda w: w not in ('men', 'women', 'male', 'female')) as w, k from r)
      select p_partkey, case p_partkey % 4 when 1 then replace(k, '-for-women-', '-') when 2 then replace(k, '-women-for-men-', '-for-')
        else array_to_string(w, '-') end as key from a""",
    "squeezed_texts": """select doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as n, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as hash from documents""",
    "amounts": """select p_partkey, round((p_size + (p_partkey % 10) / 10.0)::double * case p_partkey % 4 when 0 then 100000 when 1 then 10000000 else 1 end, 2) as amount,
      p_size::double as percent, case p_partkey % 6 when 0 then 36 when 1 then 18 when 2 then 48 when 3 then 36 when 4 then 12 end as months,
      case when p_partkey % 4 = 0 then round((p_size + (p_partkey % 10) / 10.0)::double * 100000, 2)
        when p_partkey % 4 = 1 then round((p_size + (p_partkey % 10) / 10.0)::double * 10000000, 2) end as asked from part""",
    "money_labels": """with m as (select p_partkey, p_retailprice * 1000 as x from part)
      select p_partkey, '₹' || format('{:,}', cast(trunc(x) as bigint)) as label,
        case when x < 1000 then cast(cast(floor(x) as bigint) as varchar) else
          regexp_replace(reverse(regexp_replace(reverse(cast(cast(floor(x / 1000) as bigint) as varchar)), '([0-9][0-9])', '\\1,', 'g')), '^,', '')
          || ',' || lpad(cast(cast(floor(x) as bigint) % 1000 as varchar), 3, '0') end as grouped from m""",
    "parsed_dates": """select o_orderkey, cast(try_cast(printf('%04d-%02d-%02d', 1995 + o_orderkey % 7, o_orderkey % 14, o_orderkey % 33) as date) as timestamp) as day from orders""",
    "timeline_labels": """with t as (select o_orderkey, o_orderkey % 5 = 0 as life, case when o_orderkey % 3 <> 0 then strftime(o_orderdate, '%d %b %Y') end as a,
        case when o_orderkey % 4 <> 0 then strftime(o_orderdate, '%d %b %Y') end as z from orders)
      select o_orderkey, case when life then 'Lifetime' when a is null and z is null then 'NA' when a is null then 'Until ' || z when z is null then 'From ' || a
        else a || ' to ' || z end as label from t""",
    "cosine_topk": """with x as (select label, arg_min(embedding, vec_id) as e from embeddings group by label),
      s as (select vec_id, list_cosine_similarity(embedding::double[], e::double[]) as s from embeddings cross join x)
      select vec_id, round(max(s), 4) as similarity from s group by 1""",
    "js_rounding": "select cast(floor(l_quantity / 4 + 0.5) as bigint) as quarter, count(*) as n from lineitem group by 1",
    "fuzzy_search": f"""with q as (select query_id, {_TOKENS.format('q')} as t from (values {_SQL_QUERIES}) v(query_id, q)),
      p as (select p_partkey as id, p_name as name, lower(p_name) as low, lower(concat_ws(' ', p_name, p_type, p_brand)) as blob from part),
{_SEARCHED}""",
    "search_by_table": f"""with k as (select distinct p_name || ' the ' || p_size as query_id from part),
      q as (select query_id, {_TOKENS.format('query_id')} as t from k),
      p as (select p_partkey as id, p_name || ' ' || p_size as name, lower(p_name || ' ' || p_size) as low, lower(concat_ws(' ', p_name, p_type, p_brand, p_size)) as blob from part),
{_SEARCHED}""",
    "search_tokens": f"""with t as (select conv_id, turn, {_TOKENS.format('text')} as t from conversations)
      select conv_id, turn, len(t) as n, array_to_string(t[1:5], ' ') as head from t""",
    "intent_parse": f"""with a as (select conv_id, turn, trim(text) as o,
        replace(replace(replace(replace(replace(lower(trim(text)), 'mujhe', ''), 'chahiye', ''), 'ke liye', ' for '), 'vyavasay', 'business'), 'udyam', 'business') as l from conversations),
      b as (select *, {_case(intent.PURPOSES)} as pu, {_case(intent.PROJECTS)} as pr, {_case(intent.CATEGORIES)} as category,
        try_cast(nullif(regexp_extract(replace(o, ',', ''), '\\b([0-9]{{4,9}})\\b', 1), '') as double) as loan_required from a),
      c as (select *, coalesce(pu, case when pr = 'education_loan' then 'education' when pr is not null then 'business' end) as p0 from b),
      d as (select conv_id, turn, case when p0 = 'agriculture' then 'business' else p0 end as purpose,
        coalesce(pr, case when p0 = 'agriculture' then 'agriculture' end) as project_type, category, loan_required from c),
      e as (select *, (purpose is not null)::int + (project_type is not null)::int + (category is not null)::int + (loan_required is not null)::int as n_fields from d)
      select conv_id, turn, purpose, project_type, category, loan_required, n_fields, round(0.55::double + 0.1::double * n_fields, 3) as confidence from e""",
}
