"""Merged peaks against plain loops, on odd rows against the SQL, and without a row for each sample."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa

from spanlight.functions import waveforms as W
from spanlight.plans import queries

PEAKS = "run string, g long, time long, dt int, length int, data array<float>, area double, n_hits int"


def plain(peaks):
    """time, dt, length, endtime, data, n of the peaks of one group."""
    peaks = sorted(peaks, key=lambda p: p[2])
    dt = math.gcd(*(p[3] for p in peaks))
    start, end = peaks[0][2], peaks[-1][2] + peaks[-1][4] * peaks[-1][3]
    out = [0.0] * ((end - start) // dt)
    for _, _, time, own, length, data, *_ in peaks:
        for k in range(min(length, len(data)) * (own // dt)):
            out[(time - start) // dt + k] += (data[k // (own // dt)] or 0.0) / (own // dt)
    return start, dt, len(out), end, out, len(peaks)


def some_peaks():
    rng, rows = random.Random(5), []
    for g in range(60):
        time = rng.randrange(10**12)
        for _ in range(rng.randrange(1, 6)):
            dt, length = rng.choice([4, 6, 10]), rng.randrange(1, 40)
            rows.append(("r", g, time, dt, length, [rng.choice([None, 0.0, 1.5, -2.0, 7.25]) for _ in range(length + rng.randrange(3))], 1.0, 2))
            time += dt * length + rng.choice([0, 1, 500])
    return rows


def test_against_loops(spark):
    rows = some_peaks()
    long = [("r", 1000, 0, 2, 3, [1.0, 2.0, 3.0], 1.0, 1), ("r", 1000, 3_000_000, 2, 1, [4.0], 1.0, 1)]
    nothing = [("r", 2000, 0, 2, 3, None, 1.0, 1), ("r", 2001, 0, 2, 0, [], 1.0, 1), ("r", None, 0, 2, 1, [1.0], 1.0, 1)]
    merged = W.merge_peaks(spark.createDataFrame([*rows, *long, *nothing], PEAKS), ["run", "g"])
    got = {r.g: r for r in merged.collect()}
    assert sorted(got) == [*range(60), 1000]
    for g, r in got.items():
        start, dt, length, end, data, n = plain([p for p in [*rows, *long] if p[1] == g])
        assert (r.time, r.dt, r.length, r.endtime, r.n, r.area) == (start, dt, length, end, n, float(n))
        assert np.allclose(r.data, data, atol=1e-9)
    assert "Generate" not in merged._jdf.queryExecution().optimizedPlan().toString()


def test_batches_of_bounded_size(monkeypatch):
    monkeypatch.setattr(W, "MERGED_SAMPLES", 10)
    lengths = [4, 6, 1, 25, 3, 3, 3, 3]
    lists = lambda values, kind: pa.array([[v] for v in values], pa.list_(kind))
    batch = pa.RecordBatch.from_pydict({"g": list(range(8)), "length": pa.array(lengths, pa.int32()), "__at": lists([n - 1 for n in lengths], pa.int32()), "__cuts": lists([1] * 8, pa.int32()), "__sizes": lists([1] * 8, pa.int32()), "__x": lists([float(n) for n in range(8)], pa.float64())})
    parts = list(W._spread_batches(iter([batch])))
    assert [p.column("g").to_pylist() for p in parts] == [[0, 1], [2], [3], [4, 5, 6], [7]]
    assert [d for p in parts for d in p.column("data").to_pylist()] == [[0.0] * (n - 1) + [float(k)] for k, n in enumerate(lengths)]


def test_odd_rows_against_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT vec_id, CASE WHEN vec_id = 7 THEN NULL WHEN vec_id = 8 THEN [] WHEN vec_id % 10 = 3 THEN embedding[:20] ELSE embedding END AS embedding, label FROM '/root/testdata/sf0.001/embeddings.parquet') TO '{tmp_path}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = queries.QUERIES["merge_peaks"](spark, str(tmp_path)).select("g", "time", "dt", "n_fine", "total", "moment").collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(f"SELECT g, time, dt, n_fine, total, moment FROM ({queries.SQL['merge_peaks']})").fetchall())
