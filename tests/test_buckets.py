"""Bucketed versions: equal to whole versions, and a small batch rewrites a small part."""

import glob
import random

from loomwork.sources.snapshots import BucketedTable, SnapshotTable

SCHEMA = "id long, rate double, name string, valid_to string"


def as_rows(df):
    return sorted(tuple(r) for r in df.select("id", "rate", "name", "valid_to", "version").collect())


def test_versions_equal_whole_ones(spark, tmp_path):
    rng = random.Random(1)
    first = spark.createDataFrame([(i, float(i % 7), f"n{i}", "2025" if i % 2 else None) for i in range(200)], SCHEMA)
    tables = [SnapshotTable(spark, f"{tmp_path}/whole", "id", ["rate", "name", "valid_to"]), BucketedTable(spark, f"{tmp_path}/parts", "id", ["rate", "name", "valid_to"], 16)]
    for t in tables:
        t.create(first)
    for step in range(3):
        ids = rng.sample(range(230), 1 if step == 1 else 20)
        batch = spark.createDataFrame([(i, rng.choice([None, 1.0, 9.0]), rng.choice([None, f"n{i}", "new"]), rng.choice([None, "2026"])) for i in ids], SCHEMA)
        logs = [sorted(map(str, t.apply(batch).collect())) for t in tables]
        assert logs[0] == logs[1] and as_rows(tables[0].read()) == as_rows(tables[1].read()) and tables[1].current() == step + 2
    assert as_rows(tables[1].read(1)) == as_rows(tables[0].read(1))  # old versions stay readable
    for t in tables:
        t.evolve("lang", "string", "en")
    assert {r.lang for r in tables[1].read().collect()} == {"en"} and "lang" not in tables[1].read(2).columns
    tables[1].apply(spark.createDataFrame([(5, 5.5, None, None, "hi")], SCHEMA + ", lang string"))
    assert {r.id: (r.rate, r.lang) for r in tables[1].read().where("id in (5, 6)").collect()} == {5: (5.5, "hi"), 6: (tables[0].read().where("id = 6").first().rate, "en")}


def test_one_row_rewrites_one_bucket(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path), "id", ["rate", "name", "valid_to"], 32)
    t.create(spark.createDataFrame([(i, 1.0, "n", None) for i in range(2_000)], SCHEMA))
    assert len(glob.glob(f"{tmp_path}/data/v=1/bucket=*/*.parquet")) == 32
    t.apply(spark.createDataFrame([(77, 2.0, None, None)], SCHEMA))
    assert len(glob.glob(f"{tmp_path}/data/v=2/bucket=*/*.parquet")) == 1
    assert t.read().count() == 2_000 and t.read().where("rate = 2").count() == 1 and sorted(t.manifest(2).values()) == [1] * 31 + [2]
    t.apply(spark.createDataFrame([], SCHEMA))
    assert t.manifest(3) == t.manifest(2) and t.read().count() == 2_000


def test_a_failed_batch_leaves_the_pointer(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path), "id", ["rate", "name", "valid_to"], 4)
    t.create(spark.createDataFrame([(1, 1.0, "n", None)], SCHEMA))
    t._write(spark.createDataFrame([(2, 1.0, "n", None, 1)], SCHEMA + ", version int").where("1 = 0"), 2, {})
    import shutil

    shutil.rmtree(f"{tmp_path}/manifest/v=2")  # as if the driver had died before the pointer was written
    assert t.current() == 1 and t.read().count() == 1
    t.apply(spark.createDataFrame([(2, 3.0, None, None)], SCHEMA))
    assert t.current() == 2 and t.read().count() == 2


def test_an_empty_table(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path), "id", ["rate", "name", "valid_to"], 4)
    t.create(spark.createDataFrame([], SCHEMA))
    assert t.read().count() == 0
    t.apply(spark.createDataFrame([(2, 3.0, "a", None)], SCHEMA))
    assert [r.id for r in t.read().collect()] == [2]
