"""Mappings as differences of arrays: equal to pairs without the existing ones, in several chunks, with sources that share schemes, and no shuffle of pairs."""

import random

import pytest

from loomwork.operators import runs
from loomwork.plans import history
from tests.oracles import same_as_sql


def test_query_equals_sql(spark):
    same_as_sql(spark, history, "mapping_refresh")


def test_new_mappings_equal_pairs(spark, monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 3)
    of = [(s % 3, s) for s in range(20)] + [(1, 3), (1, 3), (9, 50)]
    by = [(p % 4, p) for p in range(10)] + [(1, 0), (1, 1), (None, 7)]
    had = [(p, s) for p in range(10) for s in range(20) if (p * s) % 5 == 1] + [(None, 3), (4, None)]
    got = runs.new_mappings(spark.createDataFrame(by, "source_id int, partner_id int"), spark.createDataFrame(of, "source_id int, scheme_id int"), spark.createDataFrame(had, "partner_id int, scheme_id int"))
    want = {(p, s) for a, p in by for b, s in of if a == b} - set(had)
    rows = list(map(tuple, got.select("partner_id", "scheme_id").collect()))
    assert len(rows) == len(want) and set(rows) == want


def test_pairs_are_not_shuffled(spark):
    plan = history.mapping_refresh(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan.splitlines()[0] + plan.splitlines()[1]


def test_rows_of_an_array_come_one_after_the_other(spark, monkeypatch):
    monkeypatch.setattr(runs, "TOGETHER", 8)
    ours = spark.createDataFrame([(p % 2, p) for p in range(64)], "source_id int, partner_id int")
    theirs = spark.createDataFrame([(s % 2, s) for s in random.Random(1).sample(range(24), 24)], "source_id int, scheme_id int")
    out = runs.new_mappings(ours, theirs, spark.createDataFrame([], "partner_id int, scheme_id int"))
    for rows in out.rdd.glom().collect():
        runs_of = [rows[i : i + 12] for i in range(0, len(rows), 12)]
        assert all([r.scheme_id for r in x] == list(range(x[0].partner_id % 2, 24, 2)) and len({r.partner_id for r in x}) == 1 for x in runs_of)
    assert out.count() == 64 * 12


@pytest.mark.parametrize("most", [0, runs.BROADCAST_IDS])
def test_pairs_are_the_same_by_either_join(spark, monkeypatch, most):
    monkeypatch.setattr(runs, "CHUNK", 3)
    monkeypatch.setattr(runs, "BROADCAST_IDS", most)
    ours = spark.createDataFrame([(a, p) for p in range(6) for a in (p % 2, 2)] + [(None, 9)], "source_id int, partner_id int")
    theirs = spark.createDataFrame([(s % 2, s) for s in range(11)] + [(2, 50)], "source_id int, scheme_id int")
    had = spark.createDataFrame([(p, s) for p in range(6) for s in range(11) if (p + s) % 3 == 0] * 2 + [(p, 50) for p in range(5)] + [(None, 1), (1, None)], "partner_id int, scheme_id int")
    got = sorted(map(tuple, runs.new_mappings(ours, theirs, had).select("partner_id", "scheme_id").collect()))
    assert got == sorted([(p, s) for p in range(6) for s in range(11) if p % 2 == s % 2 and (p + s) % 3] + [(5, 50)])
