"""Heavy expressions over tables of one file: larger tables are dealt out by rows as well."""

from loomwork import session
from loomwork.llm import common
from loomwork.plans import shown
from tests.oracles import same_as_sql


def test_larger_tables_are_dealt_by_rows(spark):
    one = spark.range(0, session.SPREAD_ROWS + 1, 1, 1)
    assert session.spread(one).rdd.getNumPartitions() == -(-(session.SPREAD_ROWS + 1) // session.DEALT)
    assert session.spread(one.limit(500)).rdd.getNumPartitions() == 4


def test_numbered_listings_equal_sql(spark):
    same_as_sql(spark, shown, "numbered_listings")


def test_larger_tables_of_documents_are_not_shuffled(spark, tmp_path):
    one = spark.range(0, common.SPREAD_ROWS + 1, 1, 1).selectExpr("id as doc_id", "'a text' as text")
    for rows, shuffled in ((common.SPREAD_ROWS, True), (common.SPREAD_ROWS + 1, False)):
        one.limit(rows).write.parquet(f"{tmp_path}/{rows}/documents.parquet")
        docs = common.documents(spark, f"{tmp_path}/{rows}", "doc_id", "text")
        assert ("Exchange" in docs._jdf.queryExecution().executedPlan().toString()) == shuffled
        assert docs.count() == rows
