"""Queries on pages, documents and generated scheme texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text
from loomwork.operators import duplicates, extract, gate, names
from loomwork.session import spread
from loomwork.sources import pages


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pages.html_text(F.col("html"))
    return _read(spark, sf_dir, "pages").select("page_id", F.length(t).alias("n"), F.sha2(t, 256).alias("hash"))


def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", pages.html_title(F.col("html")).alias("title"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.explode(pages.raw_links(F.col("html"))).alias("link"))


def url_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("&loan=1"))).otherwise(F.col("url"))
    return p.select("page_id", gate.relevant_url(url).alias("relevant"), text.host(url).alias("host"), gate.authority_score(url, F.lit("social justice")).alias("authority"))


def gate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages")
    title = F.when(F.col("page_id") % 5 == 0, F.lit("Privacy Policy")).otherwise(pages.html_title(F.col("html")))
    url = F.when(F.col("page_id") % 7 == 0, F.lit("http://a.example.com/faqs/1")).otherwise(F.col("url"))
    return p.select("page_id", gate.is_other_document(url, title, F.col("html")).alias("other"))


def content_change_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against what was last stored of them: a third unchanged, a third changed, a third never seen."""
    p = _read(spark, sf_dir, "pages").withColumn("source_id", F.col("page_id") % 5)
    now = p.select("source_id", F.col("page_id").cast("string").alias("url"), F.col("html").alias("raw_text"), F.lit(None).cast("string").alias("http_etag"))
    old = p.where("page_id % 3 < 2").select(
        F.col("page_id").alias("id"), "source_id", F.col("page_id").cast("string").alias("url"),
        F.sha2(F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.lit("old")), 256).alias("content_hash"), F.lit(None).cast("string").alias("http_etag"),
    )
    return duplicates.changed_pages(now, old).select("source_id", "url", "content_hash")


def doc_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of every content hash."""
    d = _read(spark, sf_dir, "documents").withColumn("hash", text.content_hash(F.col("text")))
    return d.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by what the cues of gender and of person names find in them."""
    d = _read(spark, sf_dir, "documents")
    return d.groupBy("lang", extract.target_gender(F.col("text")).alias("gender"), gate.is_person(F.col("text")).alias("person")).agg(F.count("*").alias("n"))


_TEXTS = (
    "concat('Scheme Name: ', p_name, ' Loan Scheme ', cast(p_partkey as varchar(9)), '\n', 'Maximum loan: Rs. ', cast(p_size as varchar(9)), '.5 lakh\n',"
    " 'Interest rate: ', cast(4 + p_partkey % 9 as varchar(9)), '%\n', 'Repayment period: ', cast(1 + p_partkey % 7 as varchar(9)), ' years\n',"
    " 'Moratorium: 6 months\n', 'Annual family income: Rs. ', cast(1 + p_partkey % 5 as varchar(9)), ' lakh\n', 'Beneficiary category: ',"
    " case p_partkey % 3 when 0 then 'sc' when 1 then 'OBC' else 'st' end, '\n', 'Purpose: ', case when p_partkey % 2 = 0 then 'Business' else 'education' end, '\n',"
    " case p_partkey % 4 when 0 then 'Target gender: women\n' when 1 then 'Only for men.\n' else '' end,"
    " case p_partkey % 3 when 0 then 'Availability: Lifetime\n' when 1 then 'Scheme period: 5 May 2025 to 31 March 2027\n' else '' end,"
    " 'Documents: aadhaar, caste certificate\n', 'Channel Partner Name: Centre ', cast(p_partkey as varchar(9)), '\nState: S', cast(p_size as varchar(9)),"
    " '\nLatitude: 28.', cast(p_partkey % 90 + 10 as varchar(9)), '\nLongitude: 77.5\n')"
)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each listing, in one task for each listing, before texts are made of them."""
    return spread(_read(spark, sf_dir, "part").select(F.expr("cast(floor(p_partkey / 2) as bigint)").alias("doc_id"), "p_partkey", "p_name", "p_size"), by="doc_id")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("doc_id", "p_partkey", F.expr(_TEXTS.replace("\n", "\\n")).alias("block"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing for every pair of parts: two blocks, or one where the second is missing."""
    docs = blocks(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "block"))).alias("b"))
    body = F.array_join(F.transform("b", lambda x: x.block), "\n")
    return docs.select("doc_id", F.lit("http://x.example.com/scheme").alias("url"), F.lit("Listing").alias("title"), body.alias("text"))


def scheme_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.document_schemes(_texts(spark, sf_dir))
    return out.select(
        "doc_id", "name", "canonical_key", F.round("max_loan", 2).alias("max_loan"), "interest_rate", "tenure", "moratorium", "max_income", "purpose", "scheme_type",
        "target_gender", F.array_join("categories", ",").alias("categories"), F.array_join("required_documents", ",").alias("documents"),
        F.col("timeline.availability_type").alias("availability"), F.col("timeline.valid_to").alias("valid_to"),
    )


def partner_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.structured_partners(_texts(spark, sf_dir))
    return out.select("doc_id", "name", "canonical_key", "state", "latitude", "longitude")


def name_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against type names by spelling, then by shared words."""
    left = _read(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" (No. "), F.col("p_size").cast("string"), F.lit(")")).alias("name")).distinct()
    right = _read(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord"))
    right = right.select(F.concat(names.normalised(F.col("p_name")), F.when(F.col("ord") % 2 == 0, "").otherwise(" mark ii")).alias("key"), "ord", F.col("p_name").alias("label"))
    return names.matched(left, right).select("name", "label")


QUERIES = {
    f.__name__: f
    for f in (
        html_text, html_title, html_links, url_relevance, gate_documents, content_change_skip, doc_dedupe, document_kinds, scheme_extraction, partner_extraction,
        name_matching,
    )
}

_PLAIN = "regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<(script\\b[^>]*>.*?</script|style\\b[^>]*>.*?</style|noscript\\b[^>]*>.*?</noscript|svg\\b[^>]*>.*?</svg)\\s*>', chr(10), 'g')"
_LINES = (
    "array_to_string(list_filter(list_transform(regexp_split_to_array(replace(replace(replace(replace(replace(replace("
    f"regexp_replace({_PLAIN}, '(?s)<[^>]*>', chr(10), 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&'),"
    " '[\\r\\n]+'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), chr(10))"
)
_TITLE = (
    "coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''),"
    " nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g')), ''))"
)
_HITS = "(" + " or ".join(f"contains(h, '{x}')" for x in gate.NAME_HINTS) + ")"
_URLS = "(" + " or ".join(f"contains(u, '{x}')" for x in gate.URL_HINTS) + ")"
_WORDS = "(" + " or ".join(f"contains(lower(v), '{x}')" for x in gate.RELEVANT) + ")"

ORACLE_SQL = {
    "html_text": f"with t as (select page_id, {_LINES} as t from pages) select page_id, length(t) as n, sha256(t) as hash from t",
    "html_title": f"select page_id, {_TITLE} as title from pages",
    "html_links": """with l as (select page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["''](https?://[^"''#\\s]+)', 1))) as link from pages)
      select page_id, link from l""",
    "url_relevance": f"""with p as (select page_id, case when page_id % 3 = 0 then url || '&loan=1' else url end as v from pages),
      q as (select *, lower(regexp_extract(v, '^https?://([^/?#:]+)', 1)) as host, regexp_extract(v, '^https?://[^/?#]+([^?#]*)', 1) as path, lower(v || ' social justice ') as t from p)
      select page_id, path in ('', '/') or lower(v) like '%.pdf' or {_WORDS} as relevant, host,
        least(100, 25 + 8 * ({' + '.join(f"contains(t, '{k.lower()}')::int" for k in gate.AUTHORITY)}) + case when contains(t, 'nsfdc') then 20 else 0 end + 15) as authority from q""",
    "gate_documents": f"""with p as (select page_id, case when page_id % 5 = 0 then 'Privacy Policy' else {_TITLE} end as title,
        case when page_id % 7 = 0 then 'http://a.example.com/faqs/1' else url end as v, html from pages),
      q as (select page_id, lower(regexp_extract(v, '^https?://([^?#]*)', 1)) as u, lower(coalesce(title, '') || ' ' || substr(html, 1, 800)) as h from p)
      select page_id, {_URLS} or {_HITS} or contains(h, 'are you sure you want to sign out') as other from q""",
    "content_change_skip": """select page_id % 5 as source_id, cast(page_id as varchar) as url, sha256(html) as content_hash from pages where page_id % 3 <> 0 and length(html) >= 40""",
    "doc_dedupe": "select sha256(text) as hash, min(doc_id) as doc_id, count(*) as copies from documents group by 1",
    "document_kinds": """with g as (select lang, regexp_matches(text, '(?i)\\b(women[\\s\\-]?only|only\\s+for\\s+women|female\\s+beneficiar|mahila|women\\s+entrepreneur|women\\s+enterprise|for\\s+women|girl\\s+student|women\\s+and\\s+girls|exclusively\\s+for\\s+(women|females))\\b') as f,
        regexp_matches(text, '(?i)\\b(men[\\s\\-]?only|only\\s+for\\s+men|male\\s+beneficiar|for\\s+men\\b|exclusively\\s+for\\s+(men|males))\\b') as m,
        regexp_matches(text, '(?i)^(Mr\\.|Ms\\.|Mrs\\.|Shri|Smt\\.?|Dr\\.)\\b') or regexp_matches(text, '(?i)\\b(Manager|Deputy|Assistant|Officer|Director|Candidate|Selected|Interview|Pay Scale|Level E-|IDA Pattern|UPSC)\\b') as person from documents)
      select lang, case when f and not m then 'female' when m and not f then 'male' else 'any' end as gender, person, count(*) as n from g group by 1, 2, 3""",
    "scheme_extraction": """with s as (select p_partkey as k, cast(floor(p_partkey / 2) as bigint) as doc_id, p_name || ' Loan Scheme ' || p_partkey as name, p_size from part)
      select doc_id, name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as canonical_key, round((p_size + 0.5)::double * 100000, 2) as max_loan,
        (4 + k % 9)::double as interest_rate, (1 + k % 7) * 12 as tenure, 6 as moratorium, ((1 + k % 5) * 100000)::double as max_income,
        case when k % 2 = 0 then 'business' else 'education' end as purpose, case when k % 2 = 0 then 'term_loan' else 'educational_loan' end as scheme_type,
        case k % 4 when 0 then 'female' when 1 then 'male' else 'any' end as target_gender, case k % 3 when 0 then 'SC' when 1 then 'OBC' else 'ST' end as categories,
        'Aadhaar,Caste Certificate' as documents, case k % 3 when 0 then 'lifetime' when 1 then 'period' end as availability,
        case when k % 3 = 1 then timestamp '2027-03-31' end as valid_to from s""",
    "partner_extraction": """select cast(floor(p_partkey / 2) as bigint) as doc_id, 'Centre ' || p_partkey as name, 'centre-' || p_partkey as canonical_key, 'S' || p_size as state,
      cast('28.' || (p_partkey % 90 + 10) as double) as latitude, 77.5::double as longitude from part""",
    "name_matching": """with l as (select distinct p_name || ' (No. ' || p_size || ')' as name, lower(p_name) as n from part),
      r as (select p_name as label, min(p_partkey) as ord, lower(p_name) as base from part group by p_name),
      k as (select label, ord, base || case when ord % 2 = 0 then '' else ' mark ii' end as key from r),
      x as (select name, label from l join k on n = key),
      y as (select name, label, row_number() over (partition by name order by len(list_intersect(string_split(n, ' '), string_split(key, ' '))) desc, ord) as rn
        from l join k on len(list_intersect(string_split(n, ' '), string_split(key, ' '))) >= greatest(2, len(list_distinct(string_split(n, ' '))) - 1))
      select l.name, coalesce(x.label, y.label) as label from l left join x using (name) left join y on y.name = l.name and rn = 1""",
}
