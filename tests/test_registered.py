"""Functions in SQL text, equal to the Column functions."""

import pytest
from pyspark.sql import functions as F

from loomwork.functions import registered
from loomwork.operators import extract

TEXTS = ["  Two\tWords ", "Rs. 2.5 lakh", "₹ 1,40,000", "six years", "18 months", "4.5 % a year", "Dairy Loan (Women's) Scheme", "self-employment", "it's 'quoted' \\ back", "", None]


def test_scalars_equal_their_columns(spark):
    names = registered.register(spark)
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, x string").createOrReplaceTempView("texts")
    rows = spark.table("texts")
    for name in names:
        if registered.SCALARS.get(name, ("",))[0] != "x string":
            continue
        got = spark.sql(f"select i, {name}(x) as v from texts")
        want = rows.select("i", registered.SCALARS[name][1](F.col("x")).alias("v"))
        assert sorted(got.collect()) == sorted(want.collect()), name
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert spark.sql("select haversine_km(28.6D, 77.2D, 19.1D, 72.9D) as km").first().km == pytest.approx(1150, abs=15)
    assert spark.sql("select freshness(timestamp '2025-01-01', timestamp '2025-01-03') as f").first().f == "Fresh"


def test_numbered_sections_equal_the_extractor(spark):
    registered.register(spark)
    text = "Schemes\n1\nTerm Loan\nMaximum Loan Limit up to Rs. 5 lakh\nInterest rate 6 %\n2\nMicro Finance Scheme (MFS)\nMaximum loan Rs. 1.4 lakh at 5 %\n3\nEducational  Loan Scheme\nRs. 20 lakh at 4 %\n"
    docs = spark.createDataFrame([(1, "http://x.example/s", text), (2, "http://x.example/t", "no headings"), (3, "http://x.example/u", None), (4, "http://x.example/v", text.replace("3\n", "4\nGreen Business Scheme\nRs. 2 lakh at 7 %\n5\n"))], "doc_id long, url string, text string")
    docs.createOrReplaceTempView("listings")
    got = spark.sql("select doc_id, ordinal, name from numbered_sections(table(listings) partition by doc_id) where length(name) >= 4")
    clean = F.regexp_extract_all("text", F.lit(extract.NUMBERED), F.lit(1))
    want = docs.select("doc_id", F.posexplode(clean).alias("ordinal", "name")).withColumn("name", F.trim(F.regexp_replace("name", r"\s+", " "))).where("length(name) >= 4")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() >= 4
    found = {(r.doc_id, r.name) for r in extract.numbered_schemes(docs).collect()}
    assert found and found <= {(r.doc_id, r.name) for r in got.collect()}
