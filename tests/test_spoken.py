"""Ages as the leftmost way of saying them; links with what pages hold; both against SQL."""

from loomwork.operators import intent
from loomwork.plans import spoken
from tests.oracles import same_as_sql


def test_queries_equal_sql(spark):
    same_as_sql(spark, spoken, *spoken.QUERIES)


def test_leftmost_age_counts(spark):
    said = [(1, "main 25 saal, age 40 tak", 25), (2, "age 40, main 25", 40), (3, "मेरी उम्र ३२ है", 32), (4, "I am looking for a loan, 33 वर्षीय 51", 51), (5, "nothing", None), (6, None, None), (7, "i'm 7", 7)]
    df = spark.createDataFrame([(i, t) for i, t, _ in said], "i int, text string")
    assert {r.i: r.age for r in intent.parsed(df).collect()} == {i: a for i, _, a in said}
