"""Larger tables of documents keep their splits: reading them costs no shuffle of whole texts."""

import pytest

from loomwork.llm import common, langid, quality, suffixes
from tests.llm.data import documents, saved


@pytest.mark.parametrize("query", [langid.op1_langid, quality.op4_quality, suffixes.op6_suffixes])
def test_larger_tables_are_not_dealt_out(spark, tmp_path, monkeypatch, query):
    d = saved(spark, tmp_path, documents=documents(spark).coalesce(1), labels=spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int"))
    plans, out = {}, {}
    for rows in (common.SPREAD_ROWS, 10):
        monkeypatch.setattr(common, "SPREAD_ROWS", rows)
        made = query(spark, d)
        plans[rows] = made._jdf.queryExecution().optimizedPlan().toString()
        out[rows] = sorted(map(str, made.collect()))
    reads = common.documents(spark, d, "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition " not in plans[10] + reads  # by number, not by a key
    assert len(set(map(tuple, out.values()))) == 1 and out[10]
