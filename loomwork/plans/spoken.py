"""Queries on what people say of themselves, and on links between pages: each over rows that hold what is looked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import intent
from loomwork.sources import pages

_K, _TEXT = "c_custkey", "cast({0} as varchar(9))"
_A, _B, _C = "20 + c_custkey % 50", "18 + c_custkey % 60", "2000 + c_custkey % 7000"
#: Utterances with an age said in two ways, one way, or none; an income in several units, or none.
_SAID = (
    "case c_custkey % 6 when 0 then concat('main ', {a}, ' saal, age ', {b}, ' tak') when 1 then concat('Age: ', {b}, '; I am ', {a}, '; income Rs. ', {c})"
    " when 2 then concat('loan of 5 lakh please, umra ', {a}) when 3 then 'nothing about figures' when 4 then concat('aay ', {d}, ' lakh, mein ', {a}, ' ka hun')"
    " else concat('salary ', {c}, ' and years old ', {a}) end"
).format(a=_TEXT.format(_A), b=_TEXT.format(_B), c=_TEXT.format(_C), d=_TEXT.format("1 + c_custkey % 9"))
#: Links as pages have them: up a folder with a fragment, foreign, twice with another quote and case, of other schemes, without a target.
_MORE = (
    "'<a class=\"x\" href=\"../up?x=1#part\">u</a><a href=\"http://foreign.example/a\">f</a><A HREF=''/twice''>1</A><a href=\"/twice#b\">2</a>"
    "<a href=\"mailto:a@b.example\">m</a><a name=\"here\">n</a><a href=\"?only=query\">q</a>'"
)


def intent_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.expr(_SAID).alias("text"))
    return intent.parsed(said).select("c_custkey", "age", "annual_family_income")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page to pages of its own host, resolved, without fragments, each once."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.expr(f"concat(html, {_MORE})".replace("''/twice''", "\\'/twice\\'")).alias("html"))
    return pages.resolved_links(rows).select("page_id", F.explode("links").alias("link"))


QUERIES = {f.__name__: f for f in (intent_figures, page_links)}

ORACLE_SQL = {
    "intent_figures": f"""select c_custkey, cast(case c_custkey % 6 when 1 then {_B} when 3 then null else {_A} end as int) as age,
      case c_custkey % 6 when 1 then ({_C})::double when 4 then (1 + c_custkey % 9) * 100000::double when 5 then ({_C})::double end as annual_family_income from customer""",
    "page_links": """with p as (select page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) as origin, regexp_replace(url, '[?#].*$', '') as plain, html from pages),
      q as (select *, case when regexp_matches(substr(plain, length(origin) + 1), '/[^/]*/[^/]*$') then regexp_replace(substr(plain, length(origin) + 1), '/[^/]*/[^/]*$', '') else '' end as up from p),
      l as (select page_id, origin, plain, unnest(list_concat(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), [up || '/up?x=1', '/twice', '?only=query'])) as x from q)
      select distinct page_id, replace(regexp_replace(case when x like '?%' then plain || x else origin || x end, '#.*$', ''), '&amp;', '&') as link from l""",
}
