"""Value tests of the domain functions: the cases of FIXTURES.md and their edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomwork.functions import dates, numbers, text
from loomwork.operators import changes, duplicates, extract, finance, gate, geo, intent, names, ranking, rules, runs, search
from loomwork.sources import pages, schemas
from loomwork.sources.schemas import rows

LISTING = """Our schemes
1
Micro Finance Scheme (MFS)
Maximum Loan Limit
Loan up to Rs. 1.25 lakh per unit. Up to 90% of the project cost.
Agencies shall charge 3.5% from the CAs and CAs shall charge 6.5% from the Beneficiaries.
Repayment period within 3 years with 3 months moratorium.
2
Educational Loan Scheme (ELS)
Maximum amount of Rs. 30 lakh. Interest rate 6%. Repayment period 10 years.
"""
GENERAL = """Scheme Name: Dairy Development Scheme
Maximum loan: Rs. 1,25,000
Interest rate: 6.5%
Annual family income: Rs. 3,00,000
Repayment period: 36 months
Documents: caste certificate, Aadhaar
Beneficiary category: SC
Availability: Lifetime
Channel Partner Name: Sangaria Centre
Address: Main Road, 335804
State: Rajasthan
Latitude: 29.7902
Longitude: 74.4661
"""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def L(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("said", "value"),
    [("₹5 lakh", 500_000), ("Rs. 5,00,000", 500_000), ("1.25 Lakh", 125_000), ("2 crore", 2e7), ("INR 700", 700), ("none", None), ("1.2.3", None), ("", None)],
)
def test_amounts(spark, said, value):
    assert one(spark, text.indian_amount(L(said))) == value


@pytest.mark.parametrize(("said", "value"), [("three years", 36), ("18 months", 18), ("4 years", 48), ("36", 36), ("5 वर्ष", 60), ("twelve months", 12), ("soon", None)])
def test_months(spark, said, value):
    assert one(spark, text.months(L(said))) == value


def test_text_scalars(spark):
    assert one(spark, text.percent(L("at 6.5% a year"))) == 6.5 and one(spark, text.percent(L("7 Percent"))) == 7
    assert one(spark, text.squeezed(L(" a  b \n c "))) == "a b c"
    assert one(spark, text.canonical_key(L("Mahila — Samriddhi Yojana (2)"))) == "mahila-samriddhi-yojana-2"
    for key in ("beauty-parlour-for-women", "beauty-parlour-for-men", "beauty-parlour-men"):
        assert one(spark, text.entity_key(L(key))) == "beauty-parlour"
    assert one(spark, text.purpose_family(L("self_employment"))) == "business" == one(spark, text.purpose_family(L("Micro-Finance")))
    assert one(spark, text.purpose_family(L("higher study abroad"))) == "education" and one(spark, text.purpose_family(L("travel"))) == "travel"
    assert one(spark, text.indian_grouping(L(1234567.8))) == "12,34,567" and one(spark, text.indian_grouping(L(999.0))) == "999"
    assert one(spark, text.rupees_whole(L(125000.9))) == "₹125,000"
    assert one(spark, text.filled("{a} of {b}", a=L(1), b=L(None))) == "1 of "
    assert one(spark, text.content_hash(L("x"))) == one(spark, text.content_hash(L("x"))) != one(spark, text.content_hash(L("y")))
    assert one(spark, text.language(L("hi-IN"))) == "hi" and one(spark, text.language(L(None).cast("string"))) == "en"


def test_dates(spark):
    now = dates.at("2025-01-31 00:00:00")
    ago = lambda days: dates.freshness(F.lit(dt.datetime(2025, 1, 31) - dt.timedelta(days=days)).cast("timestamp"), now)
    assert [one(spark, ago(d)) for d in (0, 7, 8, 30, 31)] == ["Fresh", "Fresh", "Aging", "Aging", "Stale"]
    assert one(spark, dates.freshness(F.lit(None).cast("timestamp"), now)) == "Unknown"
    assert one(spark, dates.parsed_date(L("5 March 2025"))) == dt.datetime(2025, 3, 5) == one(spark, dates.parsed_date(L("05/03/2025")))
    assert one(spark, dates.parsed_date(L("31/2/2025"))) is None and one(spark, dates.parsed_date(L("5 Foo 2025"))) is None
    t = one(spark, dates.timeline(L("Scheme period: 5 May 2025 to 31 March 2027\n")))
    assert (t.availability_type, t.valid_from, t.valid_to) == ("period", dt.datetime(2025, 5, 5), dt.datetime(2027, 3, 31))
    assert one(spark, dates.timeline(L("Availability: Lifetime"))).availability_type == "lifetime"
    assert one(spark, dates.timeline(L("nothing"))).availability_type is None


def test_emi(spark):
    cases = [
        dict(loan_id=1, principal=100000.0, rate=6.5, tenure=36, moratorium=0, frequency="monthly"), dict(loan_id=2, principal=100000.0, tenure=36, moratorium=0, frequency="monthly"),
        dict(loan_id=3, principal=100000.0, rate=6.5, tenure=36, moratorium=6, frequency="monthly"), dict(loan_id=4, principal=1200.0, rate=0.0, tenure=12, moratorium=0, frequency="quarterly"),
        dict(loan_id=5, principal=0.0, rate=1.0, tenure=12, moratorium=0), dict(loan_id=6, principal=1.0, rate=1.0, tenure=0, moratorium=0),
        dict(loan_id=7, principal=1.0, rate=1.0, tenure=12, moratorium=-1), dict(loan_id=8, principal=1.0, rate=1.0, tenure=12, moratorium=12),
    ]
    loans = rows(spark, "loan", cases)
    got = {r.loan_id: r for r in finance.with_emi(loans).collect()}
    assert got[1].emi == 3064.9 and got[1].total_repayment > 100000 and got[1].warning is None
    assert got[2].emi is None and got[2].warning == "rate_unavailable"
    assert got[3].warning == "moratorium_interest_unknown" and got[4].emi == 300.0
    assert [bool(got[i].error) for i in range(1, 9)] == [False] * 4 + [True] * 4
    s = finance.schedule(loans, "loan_id").where("loan_id = 1").orderBy("period").collect()
    assert len(s) == 36 and s[-1].balance == 0 and abs(sum(r.principal for r in s) - 100000) < 0.5
    balance = 100000.0
    for r in s:  # the running computation that the closed form replaces
        interest = balance * 0.065 / 12
        balance -= 3064.9003 - interest
        assert abs(r.balance - max(0, balance)) < 0.1 and abs(r.interest - interest) < 0.02


def test_distances_and_rings(spark):
    d = one(spark, numbers.haversine_km(L(28.6139), L(77.2090), L(28.5355), L(77.3910)))
    assert 15 < d < 35 and one(spark, numbers.haversine_km(L(1.0), L(2.0), L(1.0), L(2.0))) == 0
    assert geo.ladder(50) == [20, 40] and geo.ladder(10) == [10] and geo.ladder(500) == [20, 40, 60, 100]
    users = spark.createDataFrame([(1, 0.0, 179.9), (2, 89.5, 0.0), (3, -45.0, 10.0)], "user_id int, lat double, lon double")
    partners = spark.createDataFrame([(1, 0.1, -179.9), (2, 89.6, 170.0), (3, -45.5, 10.2), (4, None, 1.0), (5, 20.0, 20.0)], "partner_id int, p_lat double, p_lon double")
    near = {(r.user_id, r.partner_id) for r in geo.within(users, partners, 100).collect()}
    km = F.round(numbers.haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")), 2)
    assert near == {(r.user_id, r.partner_id) for r in users.crossJoin(partners).where(km <= 100).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_grid_join_equals_all_pairs(spark):
    u = spark.range(300).selectExpr("id as user_id", "rand(1) * 178 - 89 as lat", "rand(2) * 360 - 180 as lon")
    p = spark.range(300).selectExpr("id as partner_id", "rand(3) * 178 - 89 as p_lat", "rand(4) * 360 - 180 as p_lon")
    km = F.round(numbers.haversine_km(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")), 2)
    for radius in (60, 500):
        want = u.crossJoin(p).where(km <= radius).select("user_id", "partner_id")
        got = geo.within(u, p, radius).select("user_id", "partner_id")
        assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_rules(spark):
    r = lambda i, kind, op, hard=True, **v: dict(scheme_id=1, ordinal=i, rule_type=kind, operator=op, is_hard=hard, **v)
    stated = rows(spark, "rule", [
        r(1, "income", "lte", num_value=500000.0), r(2, "loan_amount", "lte", num_value=125000.0), r(3, "gender", "gender_match", str_value="female"),
        r(4, "category", "in", list_value=["SC"]), r(5, "purpose", "purpose_match", str_value="business"), r(6, "age", "=="), r(7, "state", "neq", False, str_value="Goa"),
    ])
    people = rows(spark, "profile", [
        dict(profile_id=1, annual_family_income=300000.0, loan_required=125000.0, gender="female", category=" sc ", purpose="self-employment", state="Assam"),
        dict(profile_id=2, annual_family_income=800000.0, loan_required=125001.0, gender="male", category="OBC", purpose="education", state="goa"),
        dict(profile_id=3, gender="prefer_not_to_say"),
    ])
    pairs = people.select("profile_id", F.lit(1).cast("long").alias("scheme_id"))
    got = {(x.profile_id, x.ordinal): x.passed for x in rules.evaluate_rows(pairs, stated, people).collect()}
    assert [got[1, i] for i in range(1, 8)] == [True, True, True, True, True, None, True]
    assert [got[2, i] for i in range(1, 8)] == [False, False, False, False, False, None, False]
    assert [got[3, i] for i in range(1, 8)] == [None, None, True, None, None, None, None]
    d = {x.profile_id: x for x in rules.decision(rules.evaluate_rows(pairs, stated, people)).collect()}
    assert d[1].eligible and d[1].missing and not d[1].complete and not d[2].eligible and d[3].eligible
    assert d[2].hard_fails == 5 and d[2].soft_fails == 1 and d[2].blocking == ["income", "loan_amount", "gender", "category", "purpose"]


def test_derived_and_merged_rules(spark):
    schemes = rows(spark, "scheme", [dict(id=1, max_income=3e5, max_loan=1e5, categories=["SC"], activities=["dairy"], purpose="business", target_gender="female"), dict(id=2, scheme_type="educational_loan", target_gender="both"), dict(id=3)])
    derived = rules.derived_rules(schemes.withColumnRenamed("id", "scheme_id"))
    kinds = {(r.scheme_id, r.rule_type) for r in derived.collect()}
    assert kinds == {(1, k) for k in ("income", "loan_amount", "category", "project_type", "purpose", "gender")} | {(2, "purpose")}
    stored = rows(spark, "rule", [dict(scheme_id=1, ordinal=1, rule_type="income", operator="lte", num_value=1.0, is_hard=True), dict(scheme_id=1, ordinal=2, rule_type="purpose", operator="eq", str_value="x", is_hard=True)])
    merged = rules.merged_rules(stored, derived)
    assert {(r.rule_type, r.num_value) for r in merged.where("scheme_id = 1 and rule_type = 'income'").collect()} == {("income", 1.0)}
    assert [r.operator for r in merged.where("scheme_id = 1 and rule_type = 'purpose'").collect()] == ["purpose_match"]


def test_scores(spark):
    n = F.lit(None)
    assert one(spark, ranking.loan_score(L(5.0), L(1.0), L(9.0))) == 100 and one(spark, ranking.loan_score(L(5.0), n, L(9.0))) == 80
    assert one(spark, ranking.loan_score(L(10.0), n, L(9.0))) == 0 and one(spark, ranking.loan_score(n, n, L(9.0))) == 50
    assert one(spark, ranking.purpose_score(L(False), L("dairy farm"), F.array(L("Dairy"), L("x")))) == 90 and one(spark, ranking.purpose_score(L(False), n, F.array(L("a")))) == 20
    assert one(spark, ranking.cost_score(L(1.0), L(90.0))) == 70 and one(spark, ranking.cost_score(L(1.0), n)) == 60 and one(spark, ranking.cost_score(n, L(1.0))) == 50
    assert one(spark, ranking.other_score(L("S"), L("Fresh"), L(1), L("female"), L("female"))) == 100 and one(spark, ranking.other_score(n, L("Unknown"), n, n, n)) == 50
    assert one(spark, ranking.total_score(L(100.0), L(100.0), L(80.0), L(60.0), L(60.0))) == 89.0


def test_newest_and_retired(spark):
    ts = lambda y: dt.datetime(y, 1, 1)
    s = rows(spark, "scheme", [
        dict(id=10, source_id=1, canonical_key="beauty-parlour", last_verified=ts(2024), status="active"), dict(id=20, source_id=1, canonical_key="beauty-parlour-for-men", last_verified=ts(2025), status="active"),
        dict(id=30, source_id=2, canonical_key="beauty-parlour", status="unavailable"), dict(id=31, source_id=2, canonical_key="beauty-parlour-women", status="active"), dict(id=40, canonical_key=None, status="active"),
        dict(id=41, canonical_key="", status="active"), dict(id=50, source_id=1, canonical_key="beauty-parlour", last_verified=ts(2030), status="discontinued"),
    ])
    assert {r.id for r in duplicates.newest_schemes(s).collect()} == {20, 31, 40, 41}
    assert {r.id for r in duplicates.retired(s).collect()} == {10, 30}
    again = duplicates.newest_schemes(duplicates.newest_schemes(s))
    assert {r.id for r in again.collect()} == {20, 31, 40, 41}


def test_undo(spark):
    ch = rows(spark, "change", [
        dict(id=1, entity_id=7, field_name="interest_rate", old_value="6.0", new_value="7.5", status="auto_approved"), dict(id=2, entity_id=7, field_name="max_loan", old_value="1", new_value="2", status="approved"),
        dict(id=3, entity_id=7, field_name="max_loan", old_value="2", new_value="3", status="approved"), dict(id=4, entity_id=7, field_name="created", new_value="x", status="approved"),
        dict(id=5, entity_id=7, field_name="tenure", old_value="1", new_value="2", status="pending_review"),
    ])
    assert {r.id: r.undoable for r in changes.undo_verdicts(ch).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    values = spark.createDataFrame([(7, "interest_rate", "7.5"), (7, "max_loan", "3")], "entity_id long, field_name string, value string")
    new, log = changes.undone(values, ch, [1, 2], 9)
    assert {r.field_name: r.value for r in new.collect()} == {"interest_rate": "6.0", "max_loan": "3"}
    assert {(r.id, r.status, r.reviewed_by) for r in log.collect() if r.id < 3} == {(1, "undone", 9), (2, "approved", None)}
    applied = changes.applied(new, ch.where("id = 1"))
    assert {r.field_name: r.value for r in applied.collect()} == {r.field_name: r.value for r in values.collect()}


def test_differences_and_merge(spark):
    old = spark.createDataFrame([("a", 6.0, "x", "2025"), ("b", 1.0, None, None)], "key string, rate double, name string, valid_to string")
    new = spark.createDataFrame([("a", 7.5, None, None), ("b", 1.0, None, None), ("c", 2.0, "n", None)], old.schema)
    got = {(r.key, r.field_name, r.old_value, r.new_value, r.change) for r in changes.differences(old, new, "key", ["rate", "name", "valid_to"]).collect()}
    assert got == {("a", "rate", "6.0", "7.5", "update"), ("a", "valid_to", "2025", None, "update"), ("c", "rate", None, "2.0", "insert"), ("c", "name", None, "n", "insert")}
    merged = {r.key: tuple(r) for r in changes.merged(old.withColumn("version", F.lit(1)), new, "key", ["rate", "name", "valid_to"]).collect()}
    assert merged == {"a": ("a", 7.5, "x", None, 2), "b": ("b", 1.0, None, None, 1), "c": ("c", 2.0, "n", None, 1)}


def docs(spark, *values):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "doc_id long, url string, title string, text string")


def test_extraction(spark):
    d = docs(spark, ("http://x.gov.in/schemes", "Schemes", LISTING), ("http://x.gov.in/a", "Dairy", GENERAL), ("http://x.gov.in/privacy", "Privacy Policy", GENERAL), ("http://x.gov.in/b", None, None))
    numbered = {r.name: r for r in extract.numbered_schemes(d).collect()}
    m = numbered["Micro Finance Scheme (MFS)"]
    assert (m.max_loan, m.interest_rate, m.tenure, m.moratorium, m.loan_percentage, m.scheme_type) == (125000, 6.5, 36, 3, 90, "micro_finance")
    assert numbered["Educational Loan Scheme (ELS)"].purpose == "education" and numbered["Educational Loan Scheme (ELS)"].max_loan == 3_000_000
    (g,) = extract.document_schemes(d.where("doc_id = 1")).collect()
    assert (g.name, g.max_loan, g.interest_rate, g.max_income, g.tenure) == ("Dairy Development Scheme", 125000, 6.5, 300000, 36)
    assert "Caste Certificate" in g.required_documents and g.categories == ["SC"] and g.target_gender == "any" and g.timeline.availability_type == "lifetime"
    (p,) = extract.structured_partners(d.where("doc_id = 1")).collect()
    assert (p.latitude, p.longitude) == (29.7902, 74.4661) and "335804" in p.address and p.state == "Rajasthan"
    schemes, partners = extract.routed(d)
    assert {(r.doc_id, r.extractor) for r in schemes.collect()} == {(0, "numbered"), (1, "general")} and {r.confidence for r in partners.collect()} == {0.75}
    e = docs(spark, ("u", None, "Eligibility: annual family income must not exceed Rs. 5.00 lakh. State Channelizing Agencies help."))
    assert [(r.max_income, r.categories) for r in extract.shared_eligibility(e).collect()] == [(500000, ["SC"])]
    kinds = extract.partner_categories(docs(spark, ("u", None, "Channel partners: Public Sector Banks and Regional Rural Banks")))
    assert {r.partner_type for r in kinds.collect()} == {"public_sector_bank", "regional_rural_bank"}
    agency = docs(spark, ("http://x/our-channel-partners", None, "tamil; Tamil Nadu Housing Corporation; Shri A Verma"), ("http://x/careers", None, "Assam State Development Board"))
    assert [r.name for r in extract.named_partners(agency).collect()] == ["Tamil Nadu Housing Corporation"]


@pytest.mark.parametrize(("said", "gender"), [("Target gender: Women", "female"), ("only for men", "male"), ("for women and only for men", "any"), ("all people", "any"), ("gender: both", "any")])
def test_gender(spark, said, gender):
    assert one(spark, extract.target_gender(L(said))) == gender


def test_gates(spark):
    none, figures = L(None).cast("string"), L(True)
    ok = lambda name, fig=figures, body="": one(spark, gate.is_scheme(L(name), none, L(body), L("http://x.gov.in/a"), L(body), fig))
    assert ok("Dairy Term Loan") and not ok("Privacy Policy") and not ok("Shared eligibility of schemes") and not ok("short")
    assert not ok("Dairy Term Loan", L(False)) and ok("Dairy Term Loan", L(False), "maximum loan of Rs. 5 lakh") and not ok("A plain page name", L(False), "maximum loan")
    assert not one(spark, gate.is_scheme(L("Dairy Term Loan"), L("policy"), none, L("http://x/a"), none, figures))
    assert one(spark, gate.is_government(L("https://nsfdc.nic.in/x"))) and not one(spark, gate.is_government(L("http://random-loan-blog.com")))
    assert one(spark, gate.authority_score(L("ftp://x.gov.in"), none)) == 0 and one(spark, gate.authority_score(L("https://a.gov.in/loan-scheme"), none)) == 66
    v = lambda r, s: one(spark, gate.crawl_verdict(L(r).cast("boolean"), L(s).cast("int")))
    assert [v(True, 200), v(False, 200), v(None, 200), v(True, 403), v(True, 500), v(None, None)] == ["allowed", "blocked", "uncertain", "blocked", "uncertain", "uncertain"]


def test_intent(spark):
    said = ["I want a loan for a dairy business of 1 lakh", "मुझे डेयरी के लिए लोन चाहिए", "Mujhe dairy business ke liye loan chahiye", "start something", "I am 25, sc, income 2 lakh", ""]
    got = intent.parsed(spark.createDataFrame([(x,) for x in said], "text string")).collect()
    assert (got[0].purpose, got[0].project_type, got[0].loan_required) == ("business", "dairy", 100000)
    assert got[1].project_type == "dairy" == got[2].project_type and got[1].purpose == "business"
    assert got[3].category is None and got[5].n_fields == 0 and got[5].confidence == 0.55
    assert (got[4].age, got[4].category, got[4].annual_family_income) == (25, "SC", 200000)


def test_pages(spark):
    html = '<html><head><title> T </title><script>var x="<p>no</p>"</script></head><body><h1>H</h1><!-- c --><p>a &amp; b</p><a href="/r">r</a><a href="http://x.y/z#f">z</a></body></html>'
    p = spark.createDataFrame([("http://x.y/q", html), ("http://x.y/z", "<h1>Only <b>head</b></h1>")], "url string, html string")
    got = {r.url: r for r in pages.stored(p).collect()}
    assert got["http://x.y/q"].raw_text == "T\nH\na & b\nr\nz" and got["http://x.y/q"].title == "T" and got["http://x.y/z"].title == "Only head"
    assert {r.url: r.links for r in pages.resolved_links(p).collect()}["http://x.y/q"] == ["http://x.y/r", "http://x.y/z"]
    walked = pages.crawl(p, spark.createDataFrame([("http://x.y/q",)], "url string"), 2)
    assert {(r.url, r.depth) for r in walked.collect()} == {("http://x.y/q", 0), ("http://x.y/z", 1)}


def test_uploads(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>a page with enough text in it</p>")
    (tmp_path / "b.txt").write_text("short")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r.url: (r.raw_text, r.problem) for r in pages.uploads(spark, str(tmp_path)).collect()}
    assert got == {"manual://a.html": ("a page with enough text in it", None), "manual://b.txt": ("short", "too little text"), "manual://c.pdf": (None, "unreadable")}


def test_changed_pages(spark):
    body = "x" * 50
    now = spark.createDataFrame([(1, "a", body, "e1"), (1, "b", body, None), (1, "c", "short", None), (1, "d", body, "new")], "source_id int, url string, raw_text string, http_etag string")
    old = spark.createDataFrame([(1, 1, "a", "h", "e1"), (2, 1, "b", "h", None), (3, 1, "d", "h", "old")], "id int, source_id int, url string, content_hash string, http_etag string")
    assert {r.url for r in duplicates.changed_pages(now, old).collect()} == {"b", "d"} and {r.url for r in duplicates.changed_pages(now, old, forced=True).collect()} == {"a", "b", "d"}


def test_search_and_names(spark):
    s = spark.createDataFrame([(1, "Women Dairy Scheme 07", ""), (2, "Dairy Scheme 08", ""), (3, "Poultry", "")], "id int, name string, blob string").withColumn("blob", F.col("name"))
    asked = spark.createDataFrame([(1, "the dairy scheme 07"), (2, "dairy"), (3, "")], "query_id int, q string")
    got = [(r.query_id, r.id) for r in search.search(asked, s).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1), (2, 2), (2, 1)]
    left = spark.createDataFrame([("Gurgaon (South)",), ("North West Delhi",), ("Nowhere",)], "name string")
    right = spark.createDataFrame([("gurugram", 1, "G"), ("north west", 2, "NW"), ("west delhi", 3, "WD")], "key string, ord int, label string")
    assert {r.name: r.label for r in names.matched(left, right, {"gurgaon": "gurugram"}).collect()} == {"Gurgaon (South)": "G", "North West Delhi": "NW", "Nowhere": None}


def test_runs(spark):
    items = spark.createDataFrame([("5:9",), ("7",), ("x",), ("3:y",)], "item string")
    assert {(r.source_id, r.run_id) for r in runs.crawl_jobs(items).collect()} == {(5, 9), (7, None)}
    stop = lambda run, all_, keep: one(spark, runs.should_abort(L(run).cast("long"), L(all_), L(keep).cast("long")))
    assert [stop(1, True, None), stop(1, False, 1), stop(2, False, 1), stop(2, False, None), stop(None, True, 1)] == [True, False, True, False, False]
    ev = spark.createDataFrame([(1, 1, "queued", 1), (2, 1, "running", 2), (3, 1, "cancelled", 3), (4, 1, "running", 4), (5, 2, "queued", 5)], "event_id int, run_id int, event string, ts int")
    assert {r.run_id: r.status for r in changes.run_status(ev).collect()} == {1: "cancelled", 2: "queued"}
    now = dates.at("2025-01-01 12:00:00")
    mins = lambda m: F.lit(dt.datetime(2025, 1, 1, 12) - dt.timedelta(minutes=m)).cast("timestamp")
    none = F.lit(None).cast("timestamp")
    assert one(spark, dates.is_stale_run(L("running"), mins(91), none, now)) and one(spark, dates.is_stale_run(L("queued"), mins(31), none, now))
    assert not one(spark, dates.is_stale_run(L("running"), mins(89), none, now)) and not one(spark, dates.is_stale_run(L("running"), mins(99), mins(1), now))
    due = lambda status, last, every: one(spark, dates.is_due(L(True), L(status), last, L(every), now))
    assert due("ok", none, 60) and due("ok", mins(60), 60) and not due("ok", mins(59), 60) and not due("MANUAL/RESTRICTED", none, 60) and due("ok", mins(15), 0)


def test_requests(spark):
    people = rows(spark, "profile", [dict(profile_id=1, age=18, loan_required=1.0), dict(profile_id=2, age=17), dict(profile_id=3, loan_required=0.0)])
    good, bad = schemas.accepted(people, schemas.profile_problem())
    assert [r.profile_id for r in good.collect()] == [1] and {(r.profile_id, r.problem) for r in bad.collect()} == {(2, "age"), (3, "loan_required")}
    assert one(spark, schemas.settings_list(L("20, 40,x,60"))) == [20, 40, 60]
