"""Intervals without length, which rows of equal times make: literal conditions, and overlap_join against its SQL."""

import duckdb

from spanlight.operators.intervals import overlap_pairs
from spanlight.operators.peaks import hitlet_data
from spanlight.plans import queries

FOLDER = "/root/testdata/sf0.001"


def test_pairs_of_empty_and_reversed_intervals(spark):
    bounds = [(t, t + n) for t in (-10, -3, 0, 4, 9, 10, 11, 19, 20) for n in (0, 1, 6, 25, -2)]
    a = spark.createDataFrame([("r", i, *b) for i, b in enumerate(bounds)], "run_id string, row_id long, time long, endtime long")
    for window in (0, 2, -1):
        touch = lambda x, y: x[1] > y[0] - window and x[0] < y[1] + window  # noqa: B023, E731
        want = sorted((i, j) for i, x in enumerate(bounds) for j, y in enumerate(bounds) if touch(x, y))
        assert sorted((r.a_row_id, r.b_row_id) for r in overlap_pairs(a, a, 10, window).collect()) == want
        touched = sorted({i for i, _ in want})
        assert sorted(r.row_id for r in overlap_pairs(a, a, 10, window, how="left_semi").collect()) == touched
        assert sorted(r.row_id for r in overlap_pairs(a, a, 10, window, how="left_anti").collect()) == sorted(set(range(len(bounds))) - set(touched))


def test_overlap_join_of_equal_times(spark, tmp_path):
    events = str(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT event_id + k * 100000 AS event_id, ts, user_id, event_type, value * 20 AS value, props FROM '{FOLDER}/events.parquet', range(3) r(k)) TO '{events}'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{events}'")
    want = con.execute(queries.SQL["overlap_join"]).fetchall()
    slots = con.execute(f"WITH {queries.T.HITS_SQL}, {queries.T.SLOTS_SQL} SELECT count(*) FROM slots WHERE time = endtime").fetchone()[0]
    assert slots and sorted(want) == sorted(tuple(r) for r in queries.overlap_join(spark, str(tmp_path)).collect())


def test_an_empty_hitlet_goes(spark):
    hitlets = spark.createDataFrame([("r", 1, 0, 2, 5), ("r", 2, 0, 3, 3)], "run_id string, peak long, channel int, time long, endtime long")
    records = spark.createDataFrame([("r", 0, 0, 8, 1, list(range(8)))], "run_id string, channel int, time long, length int, dt int, data array<int>")
    gains = spark.createDataFrame([("r", 0, 1.0)], "run_id string, channel int, gain double")
    assert [(r.peak, r.data) for r in hitlet_data(hitlets, records, gains, 10).collect()] == [(1, [2.0, 3.0, 4.0])]
