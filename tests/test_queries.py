"""Each registered query of the library against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from spanlight.plans import peak_queries, queries

assert peak_queries.SQL is queries.SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, [tuple(None if pd.isna(v) else round(float(v), 6) if isinstance(v, float) or hasattr(v, "dtype") else str(v) if not isinstance(v, (int, bool)) else float(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None)]


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, oracle, name):
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), oracle.execute(queries.SQL[name]).fetchdf()
    (a, x), (b, y) = rows(got.where(got.notna(), None)), rows(want.where(want.notna(), None))
    assert a == b and sorted(x, key=key) == sorted(y, key=key)


def test_no_nested_loops(spark):
    for name in ("containment", "overlap_join", "replace_merged", "loop", "neighbour_distances", "touching_windows"):
        plan = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_capped_groups_agree_with_a_fold(spark):
    from spanlight.operators.intervals import gap_groups

    starts = [0, 5, 9, 14, 30, 31, 60]
    df = spark.createDataFrame([("r", t, t + 4) for t in starts], "run_id string, time long, endtime long")
    got = sorted((r.time, r.endtime, r.n) for r in gap_groups(df, 5, max_duration=12).collect())
    assert got == [(0, 9, 2), (9, 18, 2), (30, 35, 2), (60, 64, 1)]
