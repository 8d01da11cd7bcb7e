import datetime as dt
import json

from pyspark.sql import functions as F

from loomwork.functions import text, values
from loomwork.operators import extract, promotion, ranking, runs
from loomwork.sources.schemas import rows

AS_OF = "2025-06-01 00:00:00"
SCHEME = "id long, canonical_key string, source_id long, source_url string, name string, description string, max_loan double, target_gender string, valid_to string, status string, current_version int, last_verified timestamp"
STAGED = "staging_id long, entity_key string, source_id long, source_url string, name string, description string, max_loan double, target_gender string, valid_to string"


def promoted(spark, staged, schemes):
    s = spark.createDataFrame(schemes, SCHEME)
    now, changes, versions = promotion.promoted_schemes(spark.createDataFrame(staged, STAGED), s, AS_OF)
    return {r.canonical_key: r for r in now.collect()}, {(r.entity_key, r.field_name): (r.old_value, r.new_value) for r in changes.collect()}, versions.collect()


def test_schemes_are_inserted_updated_and_retired(spark):
    old = [
        (1, "dairy-loan-women", 9, "u", "Dairy Loan", None, 100.0, "female", "2025-12-31", "active", 3, None),
        (2, "dairy-loan-men", 9, "u", "Dairy", None, 100.0, "male", None, "active", 1, None),
        (3, "dairy-loan", 8, "u", "Dairy elsewhere", None, 100.0, "any", None, "active", 1, None),
        (4, "study-loan", 9, "u", "Study Loan", "text", 50.0, "any", None, "unavailable", 2, None),
    ]
    staged = [
        (1, "fish-loan", 9, "u", None, None, 5.0, "", None), (2, "dairy-loan-female", 9, "u", "Dairy Loan now", None, 120.0, None, None),
        (3, "study-loan", 9, "u", "Study Loan", "text", None, None, None), (4, "fish-loan", 9, "u", "Fish", None, None, None, None), (5, "dairy-loan-female", 9, "u", None, "later", None, None, None),
    ]
    now, changes, versions = promoted(spark, staged, old)
    assert now["fish-loan"].name == "Fish" and now["fish-loan"].max_loan == 5.0 and now["fish-loan"].target_gender == "any" and now["fish-loan"].current_version == 1 and now["fish-loan"].id == 5
    d = now["dairy-loan-female"]
    assert (d.id, d.name, d.description, d.max_loan, d.target_gender, d.valid_to, d.current_version, d.status) == (1, "Dairy Loan now", "later", 120.0, "female", None, 4, "active")
    assert d.last_verified == dt.datetime(2025, 6, 1) and now["study-loan"].last_verified is None and now["study-loan"].current_version == 2
    assert now["dairy-loan-men"].status == "discontinued" and now["dairy-loan"].status == "active"
    assert changes == {
        ("fish-loan", "max_loan"): (None, "5.0"), ("fish-loan", "target_gender"): (None, ""), ("dairy-loan-female", "name"): ("Dairy Loan", "Dairy Loan now"), ("dairy-loan-female", "canonical_key"): ("dairy-loan-women", "dairy-loan-female"),
        ("dairy-loan-female", "description"): (None, "later"), ("dairy-loan-female", "max_loan"): ("100.0", "120.0"), ("dairy-loan-female", "valid_to"): ("2025-12-31", None),
    }
    assert {(v.scheme_id, v.version_number) for v in versions} == {(1, 4), (5, 1)} and json.loads(versions[0].snapshot)["source_id"] == 9


def test_nothing_staged_changes_nothing(spark):
    old = [(1, "a", 9, "u", "A", None, 1.0, "any", None, "active", 1, None)]
    now, changes, versions = promoted(spark, [], old)
    assert set(now) == {"a"} and now["a"].current_version == 1 and not changes and not versions
    now, *_ = promoted(spark, [(1, "b", 9, "u", "B", None, None, None, None)], [])
    assert set(now) == {"b"} and now["b"].id == 1


def test_review_and_undo_bump_versions(spark):
    change = lambda i, field, status, old="o", new="n": dict(id=i, entity_type="scheme", entity_id=1, field_name=field, old_value=old, new_value=new, status=status)
    c = rows(spark, "change", [change(1, "tenure", "approved"), change(2, "tenure", "auto_approved"), change(3, "created", "auto_approved"), change(4, "max_loan", "pending_review"), change(5, "max_loan", "conflict"), change(6, "max_loan", "rejected")])
    out, back, refused = promotion.undo(c, spark.createDataFrame([(1,), (2,), (3,), (6,)], "id long"), 7)
    assert {r.id: (r.status, r.reviewed_by) for r in out.where("id < 3").collect()} == {1: ("approved", None), 2: ("undone", 7)}
    assert [(r.id, r.new_value) for r in back.collect()] == [(2, "o")]
    assert {r.id: r.problem[:7] for r in refused.collect()} == {1: "A newer", 3: "Cannot ", 6: "Change "}
    done, applied = promotion.flushed(c, 3)
    assert {r.id for r in done.where("status = 'auto_approved' and reviewed_by = 3").collect()} == {4, 5}
    entities = spark.createDataFrame([(1, 2, None), (2, None, None)], "id long, current_version int, last_verified timestamp")
    after, versions = promotion.bumped(entities, applied, AS_OF)
    assert {r.id: r.current_version for r in after.collect()} == {1: 4, 2: 1} and {(r.change_id, r.version_number) for r in versions.collect()} == {(4, 3), (5, 4)}
    said = promotion.reviewed(c, spark.createDataFrame([(4, True), (5, False)], "id long, approve boolean"), 9)
    assert {r.id: r.status for r in said.where("reviewed_by = 9").collect()} == {4: "approved", 5: "rejected"}
    assert [r.id for r in runs.waiting_changes(c).collect()] == [4, 5]


def test_numbers_in_other_digits(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.months(F.lit("५ वर्ष"))) == 60 and one(text.indian_amount(F.lit("₹ २.५ लाख"))) == 250_000 and one(text.percent(F.lit("৬ %"))) == 6
    d = spark.createDataFrame([(1, "http://x/channel-partners", "Bihar State Finance Corporation Ltd is one.")], "doc_id int, url string, text string")
    assert [r.name for r in extract.named_partners(d).collect()] == ["Bihar State Finance Corporation"]
    assert one(values.truthy(F.lit("0"))) is False and one(values.truthy(F.lit("x"))) is True and one(values.listed(F.lit(None).cast("string"))) == []


def test_near_misses_look_at_the_first_rows_only(spark):
    s = spark.createDataFrame(
        [(1, 1, "a", False, 1, 0, 5.0, 1.0, None), (1, 2, "eligibility criteria", False, 0, 0, 9.0, 1.0, None), (1, 3, "b", False, 1, 0, 6.0, None, 2.0), (2, 1, "a", True, 0, 0, 5.0, 1.0, None), (2, 3, "b", False, 1, 0, 6.0, 1.0, None), (3, 2, "shared eligibility", False, 2, 0, 1.0, 1.0, None)],
        "profile_id int, scheme_id int, name string, eligible boolean, hard_fails int, soft_fails int, score double, max_loan double, interest_rate double",
    )
    assert [(r.profile_id, r.scheme_id, r.rank) for r in ranking.near_misses(s).orderBy("profile_id", "rank").collect()] == [(1, 3, 1), (1, 1, 2), (3, 2, 1)]
