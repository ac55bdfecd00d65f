"""Interval operators on rows with nulls and repetitions, and the two-level windows on one run."""

import random

import pytest
from pyspark.sql import functions as F

from spanlight.operators.intervals import continuity_breaks, gap_groups, neighbours, overlap_pairs, positional_merge, record_links, replace_merged, sort_by_time, split_at, time_gaps

ROWS = "run_id string, time long, endtime long, note string"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([("r", 0, 5, None), ("r", 0, 5, None), ("r", 20, 25, "a"), ("r", 40, 50, None), (None, 0, 5, "b")], ROWS)


def test_semi_and_anti_with_nulls(spark, rows):
    b = spark.createDataFrame([("r", 3, 9, "m"), ("r", 49, 60, None)], ROWS)
    assert sorted(r.time for r in overlap_pairs(rows, b, 10, how="left_semi").collect()) == [0, 0, 40]
    assert sorted((r.run_id or "", r.time) for r in overlap_pairs(rows, b, 10, how="left_anti").collect()) == [("", 0), ("r", 20)]
    assert sorted((r.time, r.note or "") for r in replace_merged(rows, b, 10).collect()) == [(0, "b"), (3, "m"), (20, "a"), (49, "")]


def test_merge_with_null_keys(spark):
    a = spark.createDataFrame([(None, 1, 5), ("r", 1, 6)], "run_id string, row_id long, x long")
    b = spark.createDataFrame([("r", 1, 8), (None, 1, 7)], "run_id string, row_id long, y long")
    assert sorted((r.x, r.y) for r in positional_merge([a, b]).collect()) == [(5, 7), (6, 8)]


def brute_groups(rows, gap, left=0, right=0, most=None):
    out = []
    for t, e in sorted(rows):
        if not out or t - out[-1][1] >= gap or (most is not None and e - (out[-1][0] - left) + left + right > most):
            out.append([t, e, 0])
        out[-1][1], out[-1][2] = max(out[-1][1], e), out[-1][2] + 1
    return [(a - left, b + right, n) for a, b, n in out]


def test_one_run_over_many_cells(spark):
    rng, hour = random.Random(2), 3_600_000_000_000
    rows = [(t, t + rng.randrange(1, 3 * hour)) for t in (rng.randrange(0, 200 * hour) for _ in range(400))]
    df = spark.createDataFrame([(None, *r) for r in rows], "run_id string, time long, endtime long")
    for how in ({}, {"left": 7, "right": 9}, {"left": 7, "right": 9, "max_duration": 12 * hour}):
        got = gap_groups(df, hour // 2, **how)
        assert sorted((r.time, r.endtime, r.n) for r in got.collect()) == brute_groups(rows, hour // 2, *(how.get(k, d) for k, d in (("left", 0), ("right", 0), ("max_duration", None))))
    ordered, want, end = sorted(rows), {}, None
    for t, e in ordered:
        want[t, e] = None if end is None else t - end
        end = e if end is None else max(end, e)
    assert {(r.time, r.endtime): r.gap for r in time_gaps(df).collect()} == want
    near = neighbours(df, hour).collect()
    assert all(r.neighbours == sum(abs(e - r.endtime) < hour for _, e in rows) for r in near) and len(near) == 400
    plan = gap_groups(df, 5)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line]
    assert windows and all("__cell" in line or "__carried" in line or "__all" in line for line in windows)


def test_links_splits_and_order(spark):
    records = spark.createDataFrame([("r", 1, 0, 0, 0), ("r", 1, 1, 4, 1), ("r", 1, 2, 8, 2), ("r", 2, 3, 4, 1), ("r", 1, 4, 20, 0)], "run_id string, channel int, row_id long, time long, record_i int").withColumn("dt", F.lit(1))
    links = {r.row_id: (r.previous, r.next) for r in record_links(records, 4).collect()}
    assert links == {0: (-1, 1), 1: (0, 2), 2: (1, -1), 3: (-1, -1), 4: (-1, -1)}
    assert [r.row_id for r in sort_by_time(records, ["row_id"]).collect()] == [0, 1, 3, 2, 4]
    spans = spark.createDataFrame([("r", 0, 4), ("r", 4, 9), ("r", 12, 14)], "run_id string, time long, endtime long")
    early, late = split_at(spans, 4)
    assert (early.count(), late.count()) == (1, 2)
    with pytest.raises(Exception, match="straddles"):
        split_at(spans, 6)[0].collect()
    early, late = split_at(spans, 6, early=True)
    assert (early.count(), late.count()) == (1, 2)
    assert [(r.time, r.expected) for r in continuity_breaks(spans).collect()] == [(12, 9)]
