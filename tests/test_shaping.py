import json

from pyspark.sql import functions as F

from loomwork.operators import reasons, rules, shaping
from loomwork.sources import robots
from loomwork.sources.schemas import rows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_reasons(spark):
    r = lambda i, kind, op, **v: dict(scheme_id=1, ordinal=i, rule_type=kind, operator=op, is_hard=True, **v)
    stated = rows(spark, "rule", [r(1, "income", "lte", num_value=300000.0), r(2, "loan_amount", "gte", num_value=5e4), r(3, "category", "in", list_value=["SC", "ST"]), r(4, "gender", "gender_match", str_value="female"), r(5, "age", "gte", num_value=18.0), r(6, "state", "eq", str_value="Goa")])
    people = rows(spark, "profile", [dict(profile_id=1, annual_family_income=800000.0, loan_required=1e5, category="OBC", gender="male", state="Assam")])
    pairs = people.select("profile_id", F.lit(1).cast("long").alias("scheme_id"))
    out = reasons.with_reasons(rules.evaluate_rows(pairs, stated, people))
    got = {x.ordinal: x for x in out.collect()}
    assert got[1].reason == "Your annual family income (₹800,000) is above the scheme limit (₹300,000). You currently do not meet this income criterion."
    assert got[2].reason == "Your requested loan meets the minimum published amount." and got[2].gap is None
    assert got[3].reason == "Your category (OBC) is not in the allowed beneficiary categories (SC, ST)." and got[3].gap.scheme_requires == "SC, ST"
    assert "published for women beneficiaries" in got[4].reason and got[5].reason == "This information (age) is required to confirm eligibility."
    assert got[6].reason == "You do not meet the published 'state' condition for this scheme."
    hindi = reasons.with_reasons(rules.evaluate_rows(pairs, stated, people), F.lit(True)).where("ordinal = 2").first()
    assert hindi.reason == "आपका अनुरोधित ऋण न्यूनतम प्रकाशित राशि को पूरा करता है।"
    line = out.groupBy("scheme_id").agg(reasons.suggestion(F.array_sort(F.collect_list(F.struct("ordinal", "passed", "reason")))).alias("s")).first().s
    assert line == " Key matches: Your requested loan meets the minimum published amount.."
    assert one(spark, reasons.gender_label(F.lit(None).cast("string"), F.lit(False))) == "Both" and one(spark, reasons.freshness_label(F.lit("Fresh"), F.lit(True))) == "ताज़ा"
    assert one(spark, reasons.months_label(F.lit(6), F.lit(False))) == "6 months" and one(spark, reasons.months_label(F.lit(None).cast("int"), F.lit(False))) == "Not published"


def test_cards_guidance_and_availability(spark):
    s = spark.createDataFrame([(1, 7, 6.0, None, ["a"]), (1, 8, None, 3, [])], "profile_id int, scheme_id int, interest_rate double, tenure int, required_documents array<string>")
    c = spark.createDataFrame([(7, "tenure", "u2"), (7, "interest_rate", "u1")], "scheme_id int, field_name string, source_url string")
    got = {r.scheme_id: json.loads(r.card) for r in shaping.cards(s, c).collect()}
    assert [x["field_name"] for x in got[7]["citations"]] == ["interest_rate", "tenure"] and got[8]["citations"] == []
    g = spark.createDataFrame([(2, 7, ["later"]), (1, 7, ["first"])], "id int, scheme_id int, steps array<string>")
    steps = {r.scheme_id: r.steps for r in shaping.with_guidance(s, g).collect()}
    assert steps[7] == ["first"] and len(steps[8]) == 6
    a = {r.scheme_id: r.field_availability for r in shaping.availability(s).collect()}
    assert a[7].interest_rate and not a[7].tenure and a[7].required_documents and not a[8].required_documents
    assert one(spark, shaping.unavailable({"a": F.lit(None), "b": F.lit(1)})) == ["a"]


def test_updates_and_side_outputs(spark):
    t = spark.createDataFrame([(1, "a", 5.0, "active", 9), (2, "b", None, "retired", 9)], "id int, name string, max_income double, status string, source_id int")
    patch = spark.createDataFrame([(1, {"name": None, "max_income": "7"})], "id int, fields map<string,string>")
    assert {tuple(r) for r in shaping.updated(t, patch, "id").collect()} == {(1, None, 7.0, "active", 9), (2, "b", None, "retired", 9)}
    shared = spark.createDataFrame([(9, 3.0), (9, None)], "source_id int, max_income double")
    assert {r.id: r.max_income for r in shaping.shared_ceiling(t, shared).collect()} == {1: 3.0, 2: None}
    assert shaping.known_columns(t.withColumn("more", F.lit(1)), t).columns == t.columns
    e = shaping.error_rows(spark.createDataFrame([(1, "u", "x" * 5000)], "source_id int, url string, message string"), "fetch_error").first()
    assert len(e.message) == 4000
    a = shaping.audit_rows(spark.createDataFrame([(1, "undo", "change", 5, {"k": "v"})], "user_id int, action string, entity_type string, entity_id int, details map<string,string>"), F.lit("now")).first()
    assert json.loads(a.details) == {"k": "v"} and a.entity_id == "5"


def test_places_labels_and_fallbacks(spark):
    places = spark.createDataFrame([(1, "Delhi (NCT)"), (2, "Uttar Pradesh"), (3, "Goa")], "ord int, place string")
    asked = spark.createDataFrame([("goa",), ("delhi",), ("State of Uttar  Pradesh",), ("",), ("Atlantis",)], "name string")
    assert {r.name: r.place for r in shaping.resolved_places(asked, places).collect()} == {"goa": "Goa", "delhi": "Delhi (NCT)", "State of Uttar  Pradesh": "Uttar Pradesh", "": None, "Atlantis": None}
    state, district = shaping.address_parts(F.col("a"))
    d = spark.createDataFrame([({"state": "Goa", "county": "goa", "town": "Panaji"},), ({"region": "R", "city": "C"},)], "a map<string,string>")
    assert [tuple(r) for r in d.select(state, district).collect()] == [("Goa", "Panaji"), ("R", "C")]
    j = spark.createDataFrame([('{"Goa": ["North Goa", "South Goa"]}',), ('{"states": [{"state": "Assam", "districts": ["Nagaon"]}]}',), ("broken",)], "json string")
    assert {tuple(r) for r in shaping.district_table(j).collect()} == {("Goa", "North Goa"), ("Goa", "South Goa"), ("Assam", "Nagaon")}
    codes = spark.createDataFrame([("sc", "Scheduled Caste")], "code string, label string")
    assert {r.category: r.category_label for r in shaping.coded(spark.createDataFrame([("sc",), ("x",)], "category string"), "category", codes).collect()} == {"sc": "Scheduled Caste", "x": "x"}
    f = spark.createDataFrame([(1, 2, "far"), (2, 1, "near"), (2, 2, "far")], "request int, rank int, hit string")
    assert {(r.request, r.hit) for r in shaping.best_source(f, "request", "rank").collect()} == {(1, "far"), (2, "near")}
    t = spark.createDataFrame([("Dairy loan", "business", "running"), ("Study", None, "done")], "name string, purpose string, status string")
    assert shaping.filtered(t, F.col("name"), "DAIRY", "Business", "purpose").count() == 1 and shaping.filtered(t, F.col("name")).count() == 2
    assert [r.purpose for r in shaping.purposes(t).collect()] == ["business"] and shaping.any_busy(t).first().busy and not shaping.any_busy(t.limit(0)).first().busy


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private\n"
    s = spark.createDataFrame([(1, "http://a.b/x", 200, text), (2, "http://a.b/private/x", 200, text), (3, "http://a.b/", 404, None), (4, "http://a.b/", 500, None), (5, "http://a.b/", None, None)], "id int, url string, robots_status int, robots_text string")
    assert {r.id: r.robots_allowed for r in robots.with_robots(s, "bot").collect()} == {1: True, 2: False, 3: True, 4: None, 5: None}
