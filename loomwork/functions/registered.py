"""The library's scalar functions, and a table function of numbered listings, for SQL text: `register(spark)`.

A scalar function is registered as a SQL function whose body is the expression that the Column function makes, so a plan with it has no Python in it and is
optimized like any other. Functions whose expressions hold lambdas have no such text and are not offered. `numbered_sections` is a Python table function: it takes a table of
documents, partitioned by doc_id, and gives a row for each numbered heading.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import dates, numbers, text
from loomwork.operators.extract import NUMBERED

#: name -> (arguments, function of as many columns)
SCALARS: dict[str, tuple[str, Callable[..., Column]]] = {
    "squeezed": ("x string", text.squeezed),
    "content_hash": ("x string", text.content_hash),
    "canonical_key": ("x string", text.canonical_key),
    "entity_key": ("x string", text.entity_key),
    "purpose_family": ("x string", text.purpose_family),
    "indian_amount": ("x string", text.indian_amount),
    "percent_of": ("x string", text.percent),
    "months_of": ("x string", text.months),
    "haversine_km": ("lat1 double, lon1 double, lat2 double, lon2 double", numbers.haversine_km),
    "freshness": ("verified timestamp, now timestamp", dates.freshness),
}


class NumberedSections:
    """eval(row of doc_id, url, text) -> doc_id, ordinal, name, body of every numbered heading."""

    def eval(self, row: Row) -> Iterator[tuple]:
        clean = (row["text"] or "").replace(" ", " ").replace("\r", "")
        found = list(re.finditer(NUMBERED, clean))
        for i, m in enumerate(found):
            end = found[i + 1].start() if i + 1 < len(found) else len(clean)
            yield row["doc_id"], i, " ".join(m[1].split()), clean[m.end() : end]


def body(spark: SparkSession, arguments: str, function: Callable[..., Column]) -> tuple[str, str]:
    """(SQL text, type) of the expression that a function makes of columns with these names."""
    names = [a.split()[0] for a in arguments.split(", ")]
    empty = spark.createDataFrame([], arguments)
    made = empty.select(function(*(F.col(n) for n in names)).alias("out"))
    return made._jdf.queryExecution().analyzed().expressions().head().child().sql(), made.schema[0].dataType.simpleString()


def register(spark: SparkSession) -> list[str]:
    """Registers all functions for this session; their names."""
    for name, (arguments, function) in SCALARS.items():
        sql, kind = body(spark, arguments, function)
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {kind} return {sql}")
    spark.udtf.register("numbered_sections", F.udtf(NumberedSections, returnType="doc_id long, ordinal int, name string, body string"))
    return [*SCALARS, "numbered_sections"]
