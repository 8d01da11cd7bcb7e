"""Whole flows: generated corpus to recommendations, snapshots, streams, the driver's contract."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomwork import api
from loomwork.operators import extract
from loomwork.sources import corpus
from loomwork.sources.schemas import SCHEMAS, rows
from loomwork.sources.snapshots import SnapshotTable
from loomwork.streaming import crawl

AS_OF = "2025-06-01 00:00:00"


def test_corpus_is_extracted_as_it_was_made(spark):
    made = corpus.schemes(spark).cache()
    assert made.count() == 150
    got = extract.document_schemes(corpus.pages(made)).withColumnRenamed("doc_id", "id")
    fields = ["id", "name", "purpose", "min_loan", "max_loan", "max_income", "interest_rate", "tenure", "target_gender"]
    assert got.count() == 150 and got.select(fields).exceptAll(made.select(fields)).count() == 0
    kinds = got.select("id", F.col("timeline.availability_type").alias("availability_type"))
    assert kinds.exceptAll(made.select("id", "availability_type")).count() == 0
    p = extract.structured_partners(corpus.pages(made)).select(F.col("doc_id").alias("id"), "latitude", "longitude")
    assert p.exceptAll(made.select("id", "latitude", "longitude")).count() == 0


def test_recommendations(spark):
    s = rows(spark, "scheme", [
        dict(id=1, name="Dairy Term Loan Scheme", purpose="business", max_loan=2e5, min_loan=1e4, max_income=3e5, interest_rate=6.0, tenure=36, canonical_key="a", status="active", last_verified=dt.datetime(2025, 5, 30), activities=["dairy"]),
        dict(id=2, name="Education Loan Scheme", purpose="education", max_loan=9e5, canonical_key="b", status="active"),
        dict(id=3, name="Mahila Micro Credit Scheme", purpose="business", max_loan=9e5, target_gender="female", canonical_key="c", status="active"),
        dict(id=4, name="Privacy Policy of loans", purpose="business", max_loan=9e5, canonical_key="d", status="active"),
        dict(id=5, name="Old Dairy Loan Scheme", purpose="business", max_loan=9e5, canonical_key="e", status="discontinued"),
    ])
    people = rows(spark, "profile", [
        dict(profile_id=1, gender="male", annual_family_income=2e5, loan_required=1e5, purpose="business", project_type="dairy", age=30),
        dict(profile_id=2, gender="female", purpose="self employment", loan_required=5e5, age=30), dict(profile_id=3, purpose="travel", loan_required=1e7), dict(profile_id=4, age=5, purpose="business"),
    ])
    stored = rows(spark, "rule", [])
    best, missed = api.recommend(people, s, stored, AS_OF)
    got = {(r.profile_id, r.scheme_id): r for r in best.collect()}
    assert set(got) == {(1, 1), (2, 3)} and got[1, 1].rank == 1 and got[1, 1].detail_level == "full" and got[1, 1].complete
    assert got[1, 1].emi_estimate.emi == 3042.19 and got[2, 3].emi_estimate is None
    assert [(r.profile_id, r.scheme_id) for r in missed.orderBy("rank").collect()] and {r.profile_id for r in missed.collect()} == {3}
    assert api.listed_schemes(s).count() == 3


def test_partner_search(spark):
    users = spark.createDataFrame([(1, 28.61, 77.21), (2, 10.0, 10.0)], "user_id long, lat double, lon double")
    p = rows(spark, "partner", [
        dict(partner_id=1, name="near", latitude=28.62, longitude=77.22, status="active"), dict(partner_id=2, name="ring 40", latitude=28.9, longitude=77.21, status="active"),
        dict(partner_id=3, name="barred", latitude=28.61, longitude=77.21, status="active"), dict(partner_id=4, name="nowhere", status="active"), dict(partner_id=5, name="off", latitude=28.61, longitude=77.21, status="closed"),
    ]).withColumn("last_verified", F.lit(None).cast("timestamp"))
    status = spark.createDataFrame([(3, "Suspended"), (1, "active")], "partner_id long, status string")
    none = rows(spark, "mapping", [])
    got = api.partner_search(users, p, none, status, 7, AS_OF).orderBy("user_id", "rank").collect()
    assert [(r.user_id, r.name, r.matched_radius_km) for r in got] == [(1, "near", 20), (2, "near", None), (2, "nowhere", None), (2, "ring 40", None)]
    assert got[1].score == 25.0
    some = rows(spark, "mapping", [dict(partner_id=2, scheme_id=7, eligibility_status="eligible")])
    assert [(r.user_id, r.name) for r in api.partner_search(users, p, some, status, 7, AS_OF).orderBy("user_id").collect()] == [(1, "ring 40"), (2, "ring 40")]


def test_snapshots(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path), "key", ["rate", "max_loan"])
    t.create(spark.createDataFrame([("a", 6.0, 1.0), ("b", 5.0, 2.0)], "key string, rate double, max_loan double"))
    log = t.apply(spark.createDataFrame([("a", 7.5, None), ("c", 1.0, None)], "key string, rate double, max_loan double"))
    assert {(r.key, r.field_name, r.is_sensitive) for r in log.collect()} == {("a", "rate", False), ("c", "rate", False)}
    assert t.current() == 2 and {tuple(r) for r in t.read().collect()} == {("a", 7.5, 1.0, 2), ("b", 5.0, 2.0, 1), ("c", 1.0, None, 1)}
    t.evolve("target_gender", "string", "any")
    assert {r.target_gender for r in t.read().collect()} == {"any"} and {r.key for r in t.read(1).collect()} == {"a", "b"}


def test_queue_is_drained_once(spark, tmp_path):
    (tmp_path / "q").mkdir()
    for i, item in enumerate(["1:10", "2", "bad", "3:30", "4:40"]):
        (tmp_path / "q" / f"{i}.txt").write_text(item)
    run = lambda: crawl.drain(spark, str(tmp_path / "q"), str(tmp_path / "c"), str(tmp_path / "out"), lambda: (False, 30)).awaitTermination()
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.source_id, r.run_id, r.status) for r in got.collect()} == {(1, 10, "cancelled"), (2, None, "started"), (3, 30, "started"), (4, 40, "cancelled")}
    assert got.select("batch").distinct().count() == 2
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_due_sources_are_polled_into_the_queue(spark, tmp_path):
    old, now = dt.datetime(2020, 1, 1), dt.datetime.now() + dt.timedelta(days=1)
    table = spark.createDataFrame(
        [(1, True, None, old, 60), (2, True, None, now, 60), (3, False, None, None, 60), (4, True, "MANUAL/RESTRICTED", None, 0), (5, True, "ok", None, None)],
        "source_id long, enabled boolean, status string, last_checked timestamp, every_minutes int",
    )
    crawl.poll(spark, lambda: table, str(tmp_path / "q"), str(tmp_path / "c"), once=True).awaitTermination()
    assert {r.value for r in spark.read.text(str(tmp_path / "q")).collect()} == {"1", "5"}


def test_uploads_fall_back_to_the_whole_text_and_to_names(spark):
    docs = spark.createDataFrame(
        [
            (1, "manual://a.txt", "A", "Scheme Name: Dairy Term Loan Scheme\nMaximum loan: Rs. 2 lakh\nInterest rate: 6%\nChannel Partner Name: Good Centre One\nState: Goa\n"),
            (2, "manual://b.txt", "Fish Micro Finance Scheme", "Loans for fishing. Maximum loan Rs. 3 lakh. Interest rate 5%. Channel partner: Goa State Finance Corporation."),
            (3, "manual://c.txt", "Notes", "nothing of that kind"),
        ],
        "doc_id int, url string, title string, text string",
    )
    schemes, partners = extract.uploaded(docs)
    assert {(r.doc_id, r.max_loan) for r in schemes.collect()} == {(1, 200000.0), (2, 300000.0)}
    assert {(r.doc_id, r.confidence) for r in partners.collect()} == {(1, 0.75), (2, 0.5)}


def test_changed_content_across_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = {c: c * 50 for c in "abc"}
    steps = [[(1, "u", body["a"], 1), (1, "v", "short", 1)], [(1, "u", body["a"], 2)], [(1, "u", body["b"], 3), (1, "u", body["a"], 4)]]
    for i, step in enumerate(steps):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(dict(source_id=s, url=u, raw_text=t, fetched_ord=o)) for s, u, t, o in step))
        stream = crawl.changed(spark.readStream.schema(crawl.PAGE_SCHEMA).json(str(tmp_path / "in")))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r.fetched_ord for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 4]


def test_contract():
    own, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(own) and len(own) >= 58
    assert all(callable(f) for f in own.values()) and SCHEMAS


@pytest.mark.parametrize("name", ["rule_match_rank", "emi", "newest_per_key", "scheme_extraction", "geo_partner_search", "scd2_versions", "fuzzy_search", "html_text"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents pages conversations embeddings").split():
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    a, b = entry.queries()[name](spark, d).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    norm = lambda x: sorted(tuple("" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in x[columns].astype(object).values.tolist())
    assert norm(a) == norm(b)
