"""Registered queries of the peak, lone-hit and hitlet operators, each with DuckDB SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import waveforms as W
from ..operators import intervals as I
from ..operators import peaks as P
from . import tables as T
from .queries import ABS, GOF, MINIMA, SQL, _absolute, query

GAINS_SQL = "gains AS (SELECT DISTINCT channel, 1.0 + channel % 3 AS gain FROM {})"
PEAKS_SQL = "peaks AS (SELECT DISTINCT row_id // 3 AS peak, row_id // 3 * 192 + 10 AS time, row_id // 3 * 192 + 110 AS endtime FROM records)"
FOUND_SQL = """found AS (SELECT row_id, channel, min(i) AS l, max(i) + 1 AS r, time + min(i) AS time, time + max(i) + 1 AS endtime, time AS rt, CAST(sum(x) AS DOUBLE) AS area
FROM (SELECT *, i - row_number() OVER (PARTITION BY row_id ORDER BY i) AS grp FROM samples WHERE x >= 2500) GROUP BY row_id, channel, time, grp)"""


def _gains(rows):
    return rows.select("channel").distinct().withColumn("gain", 1.0 + F.col("channel") % 3)


def _peaks(records):
    """A peak of 50 samples of 2 ns over each three records."""
    number = F.floor(F.col("row_id") / 3).alias("peak")
    rows = records.select("run_id", number).distinct().withColumn("time", F.col("peak") * 192 + 10)
    return rows.withColumn("endtime", F.col("time") + 100).withColumn("length", F.lit(50)).withColumn("dt", F.lit(2))


def _hits(records):
    found = W.find_hits(records, F.lit(2500)).join(records.select("row_id", "channel", "dt", F.col("time").alias("record_time")), "row_id")
    return found.withColumn("record_id", F.col("row_id")).withColumn("record_endtime", F.col("record_time") + 64)


def _line(column) :
    return F.array_join(F.transform(column, lambda x: F.round(x).cast("long").cast("string")), ",")


@query("SELECT run_id, row_id, time, channel FROM hits", T.HITS_SQL)
def sort_by_time(spark, d):
    return I.sort_by_time(T.hits(spark, d).select("run_id", "row_id", "time", "channel"), ["row_id"])


@query("SELECT run_id, idx, expected FROM (SELECT *, lag(endtime) OVER (PARTITION BY run_id ORDER BY time) AS expected FROM slots WHERE idx % 5 <> 3) WHERE expected <> time", T.HITS_SQL, T.SLOTS_SQL)
def continuity_breaks(spark, d):
    return I.continuity_breaks(T.slots(spark, d).where("idx % 5 != 3")).select("run_id", "idx", "expected")


@query(
    """SELECT run_id, min(t) - 1000000000 AS time, CAST((max(e) - min(t) + 3000000000) // 1000000 AS INT) AS length, CAST(sum(n) AS BIGINT) AS n_hits, CAST(count(*) FILTER (y <> 0) AS INT) AS n_channels, CAST(sum(y) AS BIGINT) AS area, max(pause) AS max_gap, string_agg(channel || ':' || CAST(y AS BIGINT), ',' ORDER BY channel) FILTER (y <> 0) AS channels
FROM (SELECT run_id, grp, channel, min(time) AS t, max(endtime) AS e, count(*) AS n, sum(area * gain) AS y, max(pause) AS pause FROM (SELECT *, coalesce(greatest(time - max(endtime) OVER (PARTITION BY run_id, grp ORDER BY time, endtime ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS pause FROM g) JOIN gains USING (channel) GROUP BY run_id, grp, channel)
GROUP BY run_id, grp HAVING sum(y) >= 500 AND count(*) FILTER (y <> 0) >= 2""",
    T.HITS_SQL, GAINS_SQL.format("hits"),
    "m AS (SELECT *, max(endtime) OVER (PARTITION BY run_id ORDER BY time, endtime ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM hits)",
    "g AS (SELECT *, sum(CASE WHEN pe IS NULL OR time - pe >= 60000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY time, endtime ROWS UNBOUNDED PRECEDING) AS grp FROM m)",
)
def find_peaks(spark, d):
    hits = T.hits(spark, d)
    out = P.find_peaks(hits.withColumn("dt", F.lit(1_000_000)), _gains(hits), 60_000_000_000, 1_000_000_000, 2_000_000_000, 500, 2, None)
    entries = F.transform(F.map_entries("area_per_channel"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("long").cast("string")))
    return out.select("run_id", "time", "length", "n_hits", "n_channels", F.col("area").cast("long").alias("area"), "max_gap", F.array_join(entries, ",").alias("channels"))


SUMMED = """, places AS (SELECT peak, (t - p.time) // 2 AS i, channel, sum(x * gain) AS y FROM peaks p JOIN {rows} s ON s.t >= p.time AND s.t < p.endtime JOIN gains USING (channel) GROUP BY ALL)
SELECT p.peak, coalesce(CAST((SELECT sum(y) FROM places q WHERE q.peak = p.peak) AS BIGINT), 0) AS area, string_agg(CAST(coalesce(y, 0) AS BIGINT), ',' ORDER BY k) AS data, string_agg(CAST(coalesce(z, 0) AS BIGINT), ',' ORDER BY k) AS top
FROM (SELECT peak, unnest(generate_series(0, 49)) AS k FROM peaks) p LEFT JOIN (SELECT peak, i, sum(y) AS y, sum(CASE WHEN channel < 4 THEN y END) AS z FROM places GROUP BY peak, i) q ON q.peak = p.peak AND q.i = p.k GROUP BY p.peak"""


@query("")
def simple_summed_waveform(spark, d):
    records = T.records(spark, d)
    out = P.summed_waveforms(_peaks(records), records, _gains(records), 192, 4)
    return out.select("peak", F.col("area").cast("long").alias("area"), _line("data").alias("data"), _line("data_top").alias("top"))


@query("")
def sum_waveform_of_hits(spark, d):
    records = T.records(spark, d)
    out = P.summed_hits(_peaks(records), _hits(records), records, _gains(records), 192, 4, F.array_max("data") > 4000)
    return out.select("peak", F.col("area").cast("long").alias("area"), _line("data").alias("data"), _line("data_top").alias("top"))


for _name, _where in (("simple_summed_waveform", ""), ("sum_waveform_of_hits", " WHERE x >= 2500")):
    SQL[_name] = f"WITH {T.SAMPLES_SQL}, {GAINS_SQL.format('records')}, {PEAKS_SQL}, every AS (SELECT channel, time + i AS t, x FROM samples{_where})" + SUMMED.format(rows="every")


@query(
    "SELECT peak, CAST(count(DISTINCT f.channel) AS BIGINT) AS n_saturated FROM peaks p JOIN found f ON f.endtime > p.time AND f.time < p.endtime JOIN (SELECT row_id, max(x) AS m FROM samples GROUP BY row_id) t ON t.row_id = f.row_id AND m > 4000 GROUP BY peak",
    T.SAMPLES_SQL, PEAKS_SQL, FOUND_SQL,
)
def saturated_channels(spark, d):
    records = T.records(spark, d)
    out = P.summed_hits(_peaks(records), _hits(records), records, _gains(records), 192, 0, F.array_max("data") > 4000)
    return out.where("n_saturated > 0").select("peak", "n_saturated")


@query("SELECT row_id, round(arg_min(i + (0.5 * a - (c - x)) / x, i) FILTER (x > 0 AND c >= 0.5 * a), 6) AS median_time, round(arg_min(i + (0.75 * a - (c - x)) / x, i) FILTER (x > 0 AND c >= 0.75 * a) - arg_min(i + (0.25 * a - (c - x)) / x, i) FILTER (x > 0 AND c >= 0.25 * a), 6) AS width_50, time + CAST(floor(sum(x * (i + 0.5)) / max(a)) AS BIGINT) AS center_time, round(sum(x) FILTER (i < 20) / max(a), 9) AS area_fraction_top FROM sums GROUP BY row_id, time", T.SAMPLES_SQL, ABS)
def compute_properties(spark, d):
    rows = _absolute(spark, d).withColumn("endtime", F.col("time") + 64)
    rows = rows.withColumn("area_per_channel", F.map_from_entries(F.transform("data", lambda x, i: F.struct(i, x.cast("double")))))
    out = P.properties(rows, 20)
    return out.select("row_id", F.round("median_time", 6).alias("median_time"), F.round(F.get("width", F.lit(5)), 6).alias("width_50"), "center_time", F.round("area_fraction_top", 9).alias("area_fraction_top"))


PIECES = "SELECT a.row_id, CAST(row_number() OVER (PARTITION BY a.row_id ORDER BY low) - 1 AS INT) AS piece, CAST(high - low AS INT) AS length, CAST(sum(x) AS BIGINT) AS area FROM cuts c JOIN absolute a ON a.row_id = c.row_id AND i >= low AND i < high GROUP BY a.row_id, low, high"


def _pieces(spark, d, **how):
    rows = _absolute(spark, d).withColumn("endtime", F.col("time") + 64).withColumn("peak", F.col("row_id")).withColumn("area", W.total(F.col("data")))
    return P.split_peaks(rows, **how).select("row_id", "piece", "length", F.col("area").cast("long").alias("area"))


@query(PIECES, T.SAMPLES_SQL, ABS, GOF, "cuts AS (SELECT row_id, 0 AS low, CASE WHEN best > 0.75 AND place > 0 THEN place ELSE 64 END AS high FROM breaks UNION ALL SELECT row_id, place, 64 FROM breaks WHERE best > 0.75 AND place > 0)")
def natural_breaks(spark, d):
    return _pieces(spark, d, algorithm="natural_breaks", threshold=0.75)


@query("")
def split_peaks(spark, d):
    return _pieces(spark, d, algorithm="local_minimum", min_height=100.0, min_ratio=1.5)


SQL["split_peaks"] = MINIMA + ", marks AS (SELECT row_id, unnest([0, 64] || list_transform(list_filter(string_split(substr(splits, 2), ','), lambda s: s <> ''), lambda s: CAST(s AS INT))) AS low FROM r WHERE i = 63), cuts AS (SELECT * FROM (SELECT row_id, low, lead(low) OVER (PARTITION BY row_id ORDER BY low) AS high FROM marks) WHERE high > low) " + PIECES


@query(
    "SELECT p.peak, CAST(coalesce(sum(y), 0) AS BIGINT) AS area, CAST(coalesce(sum(y * i), 0) AS BIGINT) AS moment, count(DISTINCT channel) AS n_channels FROM peaks p LEFT JOIN (SELECT peak, channel, (f.time - p.time) // 2 AS i, area * gain AS y FROM peaks p JOIN found f ON f.time >= p.time AND f.endtime <= p.endtime JOIN gains USING (channel)) q USING (peak) GROUP BY p.peak",
    T.SAMPLES_SQL, GAINS_SQL.format("records"), PEAKS_SQL, FOUND_SQL,
)
def add_lone_hits(spark, d):
    records = T.records(spark, d)
    peaks = _peaks(records).withColumn("data", F.array_repeat(F.lit(0.0), 50)).withColumn("area", F.lit(0.0)).withColumn("area_per_channel", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>")))
    out = P.add_lone_hits(peaks, _hits(records), _gains(records), 192)
    moment = F.aggregate(F.transform("data", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return out.select("peak", F.round("area").cast("long").alias("area"), F.round(moment).cast("long").alias("moment"), F.size("area_per_channel").cast("long").alias("n_channels"))


BOUNDS = """ex AS (SELECT peak * 192 + 10 AS time, peak * 192 + 30 AS endtime FROM peaks),
b0 AS (SELECT *, greatest(time - 3, rt, (SELECT max(e.endtime) FROM ex e WHERE e.endtime <= f.time)) AS low0, least(endtime + 5, rt + 64, (SELECT min(e.time) FROM ex e WHERE e.time >= f.endtime)) AS high0 FROM found f),
b1 AS (SELECT *, least(high0, greatest(lead(time) OVER o, endtime)) AS high FROM b0 WINDOW o AS (PARTITION BY channel ORDER BY time, endtime, row_id)),
bounds AS (SELECT *, greatest(low0, least(lag(high) OVER o, time)) AS low FROM b1 WINDOW o AS (PARTITION BY channel ORDER BY time, endtime, row_id))"""


def _bounded(spark, d):
    records = T.records(spark, d)
    excluded = _peaks(records).withColumn("endtime", F.col("time") + 20)
    return records, P.integration_bounds(_hits(records), 3, 5, excluded)


@query("SELECT row_id, time, low, high FROM bounds", T.SAMPLES_SQL, PEAKS_SQL, FOUND_SQL, BOUNDS)
def hit_integration_bounds(spark, d):
    return _bounded(spark, d)[1].select("row_id", "time", "low", "high")


@query("SELECT b.row_id, b.time, round(sum(x) + 0.25 * (high - low), 6) AS area FROM bounds b JOIN samples s ON s.row_id = b.row_id AND s.time + s.i >= low AND s.time + s.i < high GROUP BY b.row_id, b.time, low, high", T.SAMPLES_SQL, PEAKS_SQL, FOUND_SQL, BOUNDS)
def integrate_lone_hits(spark, d):
    records, bounded = _bounded(spark, d)
    return P.integrate_hits(bounded, records.withColumn("baseline", F.lit(100.25))).select("row_id", "time", F.round("area", 6).alias("area"))


JOINED_HITS = """e AS (SELECT channel, time - 70 AS time, endtime + 70 AS endtime FROM found WHERE channel BETWEEN 1 AND 6),
m AS (SELECT *, coalesce(CAST(lag(endtime) OVER (PARTITION BY channel ORDER BY time, endtime) < time AS INT), 1) AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY channel ORDER BY time, endtime ROWS UNBOUNDED PRECEDING) AS grp FROM m),
hitlets AS (SELECT channel, min(time) AS time, arg_max(endtime, time * 1000000 + endtime) AS endtime, count(*) AS n FROM g GROUP BY channel, grp)"""


def _hitlets(records):
    return P.hitlets_from_hits(_hits(records), 70, 70, (1, 6))


@query("SELECT channel, time, endtime, n FROM hitlets", T.SAMPLES_SQL, FOUND_SQL, JOINED_HITS)
def create_hitlets(spark, d):
    return _hitlets(T.records(spark, d)).drop("run_id")


@query(
    """SELECT h.channel, c.t AS time, CAST(c.e - c.t AS INT) AS length, CAST(sum(x * gain) AS BIGINT) AS area, CAST(sum(x * gain * (s.time + s.i - c.t)) AS BIGINT) AS moment
FROM hitlets h JOIN (SELECT h.channel, h.time, min(greatest(r.time, h.time)) AS t, max(least(r.time + 64, h.endtime)) AS e FROM hitlets h JOIN records r ON r.channel = h.channel AND r.time + 64 > h.time AND r.time < h.endtime GROUP BY h.channel, h.time) c ON c.channel = h.channel AND c.time = h.time
JOIN samples s ON s.channel = h.channel AND s.time + s.i >= c.t AND s.time + s.i < c.e JOIN gains ON gains.channel = h.channel GROUP BY h.channel, c.t, c.e""",
    T.SAMPLES_SQL, GAINS_SQL.format("records"), FOUND_SQL, JOINED_HITS,
)
def hitlet_data(spark, d):
    records = T.records(spark, d)
    hitlets = _hitlets(records).withColumn("peak", F.col("time") * 1000 + F.col("channel"))
    out = P.hitlet_data(hitlets, records, _gains(records), 192)
    moment = F.aggregate(F.transform("data", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return out.select("channel", "time", "length", F.round("area").cast("long").alias("area"), F.round(moment).cast("long").alias("moment"))


@query(
    "SELECT s.row_id, string_agg(CASE WHEN EXISTS (SELECT 1 FROM found f WHERE f.channel = s.channel AND s.time + s.i >= f.time - 2 AND s.time + s.i < f.endtime + 15) THEN x ELSE 0 END, ',' ORDER BY i) AS data FROM samples s GROUP BY s.row_id",
    T.SAMPLES_SQL, FOUND_SQL,
)
def cut_outside_hits(spark, d):
    records = T.records(spark, d)
    return P.cut_outside_hits(records, _hits(records), 64).select("row_id", _line("data").alias("data"))


@query("SELECT row_id, CAST(time AS BIGINT) AS time, CAST(channel AS SMALLINT) AS channel, CAST(NULL AS INT) AS reduction_level FROM records", T.RECORDS_SQL)
def raw_to_records(spark, d):
    return P.raw_to_records(T.records(spark, d), {"row_id": "long", "time": "long", "channel": "short", "reduction_level": "int"})


@query(
    "SELECT row_id, round(last_value(m IGNORE NULLS) OVER o, 6) AS baseline, round(last_value(s IGNORE NULLS) OVER o, 6) AS baseline_rms FROM (SELECT row_id, time, channel, CASE WHEN row_id % 3 = 0 THEN avg(x) END AS m, CASE WHEN row_id % 3 = 0 THEN stddev_pop(x) END AS s FROM samples WHERE i < 40 GROUP BY row_id, time, channel) WINDOW o AS (PARTITION BY channel ORDER BY time, row_id ROWS UNBOUNDED PRECEDING)",
    T.SAMPLES_SQL,
)
def carried_baseline(spark, d):
    out = P.carried_baseline(T.records(spark, d).withColumn("record_i", F.col("row_id") % 3), 40)
    return out.select("row_id", F.round("baseline", 6).alias("baseline"), F.round("baseline_rms", 6).alias("baseline_rms"))


REGION = """ranked AS (SELECT row_id, i, x, row_number() OVER w AS j, sum(x) OVER w AS c, lead(x) OVER w AS low, sum(x) OVER (PARTITION BY row_id) AS a FROM (SELECT row_id, i, CAST(x AS DOUBLE) AS x FROM absolute) WINDOW w AS (PARTITION BY row_id ORDER BY x DESC, i)),
level AS (SELECT row_id, min(j) AS j, arg_min((1 - 0.6 * a / (c - j * low)) * c / j + 0.6 * a / (c - j * low) * low, j) AS height FROM ranked WHERE low IS NOT NULL AND (j = 1 OR low < x) AND (c - j * low) >= 0.6 * a GROUP BY row_id),
held AS (SELECT r.row_id, r.i, l.height, r.i - row_number() OVER (PARTITION BY r.row_id ORDER BY r.i) AS grp FROM ranked r JOIN level l ON l.row_id = r.row_id AND r.j <= l.j)"""


@query("SELECT row_id, string_agg(l || '-' || h, ',' ORDER BY l) AS runs, round(min(height), 4) AS height FROM (SELECT row_id, min(i) AS l, max(i) + 1 AS h, min(height) AS height FROM held GROUP BY row_id, grp) GROUP BY row_id", T.SAMPLES_SQL, ABS, REGION)
def density_regions(spark, d):
    out = _absolute(spark, d).select("row_id", F.element_at(W.density_regions(F.col("data").cast("array<double>"), [0.6], True), 1).alias("r"))
    runs = F.array_join(F.zip_with("r.left", "r.right", lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string"))), ",")
    return out.select("row_id", runs.alias("runs"), F.round("r.height", 4).alias("height"))


@query("SELECT row_id, CAST(min(i) * 2 AS DOUBLE) AS \"left\", CAST((max(i) + 1) * 2 AS DOUBLE) AS \"right\" FROM held GROUP BY row_id", T.SAMPLES_SQL, ABS, REGION)
def density_width(spark, d):
    out = _absolute(spark, d).select("row_id", F.element_at(W.density_width(F.col("data"), [0.6], F.lit(2)), 1).alias("w"))
    return out.select("row_id", "w.left", "w.right")
