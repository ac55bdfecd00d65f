"""Values put at their places, by sorting and without a search for each place."""

import random

from pyspark.sql import functions as F

from spanlight.functions import waveforms as W
from spanlight.operators.peaks import add_lone_hits, summed_waveforms


def test_against_loops(spark):
    rng, rows = random.Random(3), [(0, 4, None), (1, 3, []), (2, 0, []), (3, 0, None)]
    for g in range(4, 60):
        n = rng.randrange(1, 30)
        rows.append((g, n, [(i, rng.choice([None, 0.5, -3.0])) for i in rng.sample(range(n), rng.randrange(n + 1))]))
    found = spark.createDataFrame(rows, "g int, n int, e array<struct<i: int, x: double>>").select("g", W.placed(F.col("e"), F.col("n"), F.lit(0.0)).alias("data"))
    want = {g: [dict(e or []).get(i) or 0.0 for i in range(n)] for g, n, e in rows}
    assert {r.g: r.data for r in found.collect()} == want


def test_long_waveforms_without_searches(spark):
    pieces = spark.createDataFrame([(1, 20_000, at, [1, 2, 3]) for at in range(0, 20_000, 2)], "g int, n int, at int, data array<int>")
    summed = W.sum_waveform(pieces, ["g"], "n", "at")
    data = summed.first()["data"]
    assert data == [1, 2, *[4, 2] * 9_999] and dict(summed.dtypes)["data"] == "array<bigint>"
    assert "map" not in summed._jdf.queryExecution().optimizedPlan().toString()


def test_peaks_without_samples_and_lone_hits(spark):
    peaks = spark.createDataFrame([("r", 1, 0, 6, 3, 2), ("r", 2, 4, 4, 0, 2), ("r", 3, 90, 94, 2, 2)], "run_id string, peak long, time long, endtime long, length int, dt int")
    records = spark.createDataFrame([("r", 0, 1, 4, 1, [1, 2, 3, 4])], "run_id string, channel int, time long, length int, dt int, data array<int>")
    gains = spark.createDataFrame([(0, 2.0), (1, 1.0)], "channel int, gain double")
    summed = summed_waveforms(peaks, records, gains, 10, 1)
    assert {r.peak: (r.data, r.data_top) for r in summed.collect()} == {1: ([2.0, 10.0, 8.0],) * 2, 2: ([], []), 3: ([0.0, 0.0],) * 2}
    hits = spark.createDataFrame([("r", 0, 2, 3, 5.0), ("r", 1, 3, 4, 7.0), ("r", 1, 5, 6, 1.0)], "run_id string, channel int, time long, endtime long, area double")
    added = add_lone_hits(summed, hits, gains, 10).collect()
    assert {r.peak: (r.data, r.area) for r in added} == {1: ([2.0, 27.0, 9.0], 38.0), 2: ([], 0.0), 3: ([0.0, 0.0], 0.0)}
