"""Extraction seeks a pattern once, only in texts with a word that it needs, and moves narrow rows instead of texts."""

from pyspark.sql import functions as F

from loomwork.functions import dates, text
from loomwork.operators import extract
from loomwork.plans import extraction
from tests.oracles import same_as_sql

PARTS = [
    "Maximum loan: Rs. 1,40,000", "UPTO Rs. 2 lakh", "Finance   limit Rs. 9 lakh", "max. ₹ २.५ lakh", "Min. loan 500", "minimum finance: Rs. 700", "ROI 6.5 %", "Rate of  interest 12%", "charged 7%", "Beneficiary 4 %",
    "annual income Rs. 3 lakh", "Income ceiling 50,000", "Repayment in 5 years", "loan period 30 months", "TENURE 12", "gestation 6 months", "Moratorium: ३ months", "Scheme Name:  A Fish Term Loan", "Scheme name:\n     \nNext line here",
    "Beneficiary  category: obc", "Purpose: Self employment", "purpose: ", "Target gender: Women", "gender : any", "women-only", "men only", "only for men", "male beneficiary", "girl student", "exclusively for males", "women and girls",
    "Availability: Lifetime", "available lifetime", "Valid from 5 May 2025 to 31 March 2027.", "Scheme period: 1/2/2025 – 3/4/2026\n", "validity: now till later", "self-employment", "MICRO", "Vocational", "scheduled  caste", "for SC people",
    "अनुसूचित जाति", "PAN, aadhaar and a Caste Certificate", "K\u212aİ", "documents for all", "Mahila", "",
]


def test_patterns_are_sought_once_and_texts_are_not_shuffled(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    made = extraction.scheme_extraction(spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    plan = made.optimizedPlan().toString()
    for pattern in (extract.FIELD_PATTERNS["max_income"][0][1], extract.FIELD_PATTERNS["interest_rate"][0][1], extract._FEMALE, extract._LABELLED, r"(?im)(?=^[ \t]*Scheme\s*Name\s*:)"):
        assert plan.count(pattern) == 1, pattern
    moved = [x for x in made.executedPlan().toString().splitlines() if "Exchange" in x]
    assert len(moved) == 1 and "REPARTITION_BY_NUM" in moved[0]


def test_fields_are_those_of_patterns_without_cues(spark):
    said = [*PARTS, *(f"{PARTS[i * 7 % len(PARTS)]}\n{PARTS[i * 11 % len(PARTS)]}\n{PARTS[i * 3 % len(PARTS)]} {PARTS[i]}" for i in range(len(PARTS))), None]
    blocks = spark.createDataFrame([(i, "http://a.b/c", "T", x) for i, x in enumerate(said)], "doc_id int, url string, title string, text string").coalesce(1)
    raw = lambda k: text.first_of(text.ascii_digits(F.col("text")), [p for _, p in extract.FIELD_PATTERNS[k]])
    x = F.col("text")
    plain = {
        **{k: text.indian_amount(raw(k)) for k in ("max_loan", "min_loan", "max_income")}, "interest_rate": text.percent(raw("interest_rate")), **{k: text.months(raw(k)) for k in ("tenure", "moratorium")},
        "target_gender": extract.target_gender(x), "timeline": dates.timeline(x), "required_documents": extract.required_documents(x),
        "scheme_type": F.when(x.rlike("(?i)education|educational|vocational"), "educational_loan").when(x.rlike(r"(?i)micro|self[\-\s]*employment|business|enterprise|livelihood"), "term_loan"),
        "sc": F.coalesce(text.extract(x, r"(?i)beneficiary\s*category\s*:\s*([A-Za-z]+)").isNull() & x.rlike(r"(?i)scheduled\s*caste|\bSC\b|अनुसूचित\s*जाति"), F.lit(False)),
    }
    want = {r.doc_id: r for r in blocks.select("doc_id", *(c.alias(k) for k, c in plain.items())).collect()}
    got = extract.scheme_fields(blocks).withColumn("sc", F.coalesce(F.col("categories") == F.array(F.lit("SC")), F.lit(False))).select("doc_id", *plain).collect()
    assert len(got) == len(said) and [r for r in got if r != want[r.doc_id]] == []
    assert sum(r.max_loan is not None for r in got) >= 20 and {r.target_gender for r in got} == {"any", "female", "male"} and {r.timeline.availability_type for r in got} == {None, "lifetime", "period"}


def test_extraction_equals_sql(spark):
    same_as_sql(spark, extraction, "scheme_extraction", "partner_extraction")
