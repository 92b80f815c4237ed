"""The registered queries of the operators and the pipeline against their SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import corpus_pipeline
from loomlake.llm import queries

SF = "/root/testdata/sf0.001"
SQL = {**queries.ORACLES, "pipeline": corpus_pipeline.ORACLE_SQL}


def _plain(v):
    return ("nan" if math.isnan(v) else round(v, 5) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = {**queries.QUERIES, "pipeline": corpus_pipeline.run}[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(SQL[name])
    at = [[c[0] for c in result.description].index(c) for c in columns]
    expected = sorted(tuple(str(_plain(r[i])) for i in at) for r in result.fetchall())
    assert sorted(tuple(str(_plain(r[c])) for c in columns) for r in df.collect()) == expected
