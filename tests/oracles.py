"""Queries against their SQL on a small table, value by value."""

import os

import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations"


def same_as_sql(spark, module, *names, sf_dir="/root/testdata/sf0.001"):
    if not os.path.isdir(sf_dir):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    shown = lambda v: None if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    for name in names:
        df = module.QUERIES[name](spark, sf_dir)
        cur = con.execute(module.ORACLE_SQL[name])
        columns = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(columns), name
        got = sorted((tuple(map(shown, r)) for r in df.select(*columns).collect()), key=str)
        want = sorted((tuple(map(shown, r)) for r in cur.fetchall()), key=str)
        assert got and got == want, name
