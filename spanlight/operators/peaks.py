"""Peaks, lone hits and hitlets: intervals that gather hits and records, and the waveforms summed into them.

Hits have run_id, channel, time, endtime, area and, where a waveform is asked
for, left and right (samples of the record ``record_id``).  Records have run_id,
row_id, channel, time, length, dt and data.  ``gains`` is a table (channel,
gain): one row a channel, far smaller than the data, joined by its key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import waveforms as W
from .intervals import group_starts, joined_hits, overlap_pairs

PEAK = ["run_id", "peak"]


def with_gain(rows: DataFrame, gains: DataFrame) -> DataFrame:
    """``rows`` with the ``gain`` of their channel; a channel that the table lacks is an error when the result is read."""
    out = rows.join(gains.select("channel", F.col("gain").alias("__gain")), "channel", "left")
    return out.withColumn("gain", F.coalesce("__gain", F.raise_error(F.lit("a channel has no gain")).cast("double"))).drop("__gain")


def find_peaks(hits: DataFrame, gains: DataFrame, gap: int = 300, left: int = 20, right: int = 150, min_area: float = 0.0, min_channels: int = 2, max_duration: int | None = 10_000_000) -> DataFrame:
    """Gap groups of hits with area and channels enough: run_id, time, endtime, length, dt, n_hits, n_channels, area, max_gap, area_per_channel (a map).

    Areas are scaled by the channels' gains; channels whose areas add up to 0
    don't count.  Hits need ``dt``, the same for all of a group.
    """
    if gap <= left + right:
        raise ValueError("the gap is larger than both extensions")
    if min_channels < 1:
        raise ValueError("a peak has at least one channel")
    rows = with_gain(group_starts(hits, gap, left, right, ["run_id"], max_duration), gains)
    group = ["run_id", "__group", "__part"]
    before = F.max("endtime").over(Window.partitionBy(*group).orderBy("time", "endtime").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__pause", F.greatest(F.col("time") - before, F.lit(0)))
    bounds = [F.min("time").alias("__t"), F.max("endtime").alias("__e"), F.min("dt").alias("dt"), F.count(F.lit(1)).alias("n"), F.max("__pause").alias("pause")]
    channels = rows.groupBy(*group, "channel").agg(F.sum(F.col("area") * F.col("gain")).alias("area"), *bounds)
    entry = F.when(F.col("area") != 0, F.struct("channel", "area"))
    peaks = channels.groupBy(*group).agg(F.min("__t").alias("__t"), F.max("__e").alias("__e"), F.min("dt").alias("dt"), F.sum("n").alias("n_hits"), F.sum("area").alias("area"), F.coalesce(F.max("pause"), F.lit(0)).alias("max_gap"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("area_per_channel"))
    length = F.floor((F.col("__e") - F.col("__t") + left + right) / F.col("dt")).cast("int")
    peaks = peaks.withColumn("n_channels", F.size("area_per_channel")).where((F.col("area") >= min_area) & (F.col("n_channels") >= min_channels))
    peaks = peaks.withColumn("time", F.col("__t") - left).withColumn("length", length).withColumn("endtime", F.col("time") + F.col("length").cast("long") * F.col("dt"))
    return peaks.select("run_id", "time", "endtime", "length", "dt", "n_hits", "n_channels", "area", "max_gap", "area_per_channel")


def _samples(pairs: DataFrame, low: Column, high: Column) -> DataFrame:
    """A row for each sample of a_data from place ``low`` to ``high`` that begins in the peak (b_), at its place ``i`` there."""
    taken = pairs.select("*", F.posexplode(F.slice("a_data", low + 1, F.greatest(high - low, F.lit(0)))).alias("__k", "__x"))
    at = F.floor((F.col("a_time") + (low + F.col("__k")) * F.col("a_dt") - F.col("b_time")) / F.col("b_dt"))
    return taken.withColumn("i", at.cast("int")).where("i >= 0 AND i < b_length")


def _gathered(peaks: DataFrame, samples: DataFrame, n_top: int) -> DataFrame:
    per_channel = samples.groupBy(F.col("b_run_id").alias("run_id"), F.col("b_peak").alias("peak"), F.col("a_channel").alias("channel")).agg(F.sum("y").alias("y"))
    per_channel = per_channel.groupBy(*PEAK).agg(F.sum("y").alias("area"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "y")))).alias("area_per_channel"))
    top = F.sum(F.when(F.col("a_channel") < n_top, F.col("y")).otherwise(0.0)).alias("t")
    places = samples.groupBy(F.col("b_run_id").alias("run_id"), F.col("b_peak").alias("peak"), "i").agg(F.sum("y").alias("y"), top)
    places = places.groupBy(*PEAK).agg(F.collect_list(F.struct("i", F.col("y").alias("x"))).alias("__m"), F.collect_list(F.struct("i", F.col("t").alias("x"))).alias("__top"))
    dense = lambda m: W.placed(F.col(m), F.col("length"), F.lit(0.0))
    rest = [c for c in peaks.columns if c not in ("area", "area_per_channel", "data", "data_top")]
    out = peaks.select(*rest).join(places, PEAK, "left").join(per_channel, PEAK, "left").withColumn("data", dense("__m"))
    out = out.withColumn("data_top", dense("__top")) if n_top else out
    return out.withColumn("area", F.coalesce("area", F.lit(0.0))).drop("__m", "__top")


def summed_waveforms(peaks: DataFrame, records: DataFrame, gains: DataFrame, width: int, n_top: int = 0) -> DataFrame:
    """``peaks`` (with ``peak``, an id) and the samples of all records that they touch, scaled and added up: data, area, area_per_channel, and data_top of channels below ``n_top``."""
    pairs = overlap_pairs(with_gain(records.withColumn("endtime", F.col("time") + F.col("length").cast("long") * F.col("dt")), gains), peaks.select(*PEAK, "time", "endtime", "length", "dt"), width)
    low = F.greatest(F.lit(0), F.ceil((F.col("b_time") - F.col("a_time")) / F.col("a_dt"))).cast("int")
    high = F.least(F.col("a_length"), F.ceil((F.col("b_endtime") - F.col("a_time")) / F.col("a_dt"))).cast("int")
    return _gathered(peaks, _samples(pairs, low, high).withColumn("y", F.col("__x") * F.col("a_gain")), n_top)


def summed_hits(peaks: DataFrame, hits: DataFrame, records: DataFrame, gains: DataFrame, width: int, n_top: int = 0, saturated: Column | None = None) -> DataFrame:
    """As ``summed_waveforms``, but only the samples inside hits count; and n_saturated, the number of channels with a record for which ``saturated`` holds."""
    flag = F.coalesce(saturated, F.lit(False)) if saturated is not None else F.lit(False)
    source = records.select(F.col("run_id").alias("__r"), F.col("row_id").alias("__id"), "dt", "data", F.col("time").alias("__t0"), flag.alias("saturated"))
    own = hits.drop("dt", "data").join(source, (F.col("run_id") == F.col("__r")) & (F.col("record_id") == F.col("__id"))).drop("__r", "__id")
    own = own.withColumn("data", F.slice("data", F.col("left") + 1, F.col("right") - F.col("left"))).withColumn("time", F.col("__t0") + F.col("left") * F.col("dt")).withColumn("endtime", F.col("__t0") + F.col("right") * F.col("dt"))
    pairs = overlap_pairs(with_gain(own, gains), peaks.select(*PEAK, "time", "endtime", "length", "dt"), width)
    out = _gathered(peaks, _samples(pairs, F.lit(0), F.size("a_data")).withColumn("y", F.col("__x") * F.col("a_gain")), n_top)
    full = pairs.where("a_saturated").groupBy(F.col("b_run_id").alias("run_id"), F.col("b_peak").alias("peak")).agg(F.count_distinct("a_channel").alias("n_saturated"))
    return out.join(full, PEAK, "left").withColumn("n_saturated", F.coalesce("n_saturated", F.lit(0)))


def properties(peaks: DataFrame, n_top: int = 0) -> DataFrame:
    """``peaks`` with median_time, width, area_decile_from_midpoint and center_time, and area_fraction_top with ``n_top``."""
    out = peaks.withColumn("__w", W.widths(F.col("data"), F.col("length"), F.col("dt")))
    out = out.select("*", "__w.*").drop("__w").withColumn("center_time", W.centre_time(F.col("data"), F.col("time"), F.col("endtime"), F.col("dt")))
    if not n_top:
        return out
    part = lambda keep: F.aggregate(F.map_values(F.map_filter("area_per_channel", keep)), F.lit(0.0), lambda a, x: a + x)
    whole = part(lambda k, v: F.lit(True))
    return out.withColumn("area_fraction_top", F.when(whole > 0, part(lambda k, v: k < n_top) / whole).otherwise(F.lit(float("nan"))))


SPLITTERS: dict[str, Callable[..., Column]] = {
    "local_minimum": lambda data, min_height=0.0, min_ratio=0.0: W.local_minimum_splits(data, min_height, min_ratio),
    "natural_breaks": lambda data, threshold=0.5, wing=0, low=False: W.natural_break(data, threshold, wing, low),
}


def split_peaks(peaks: DataFrame, algorithm: str = "local_minimum", iterations: int = 1, min_area: float = 0.0, **options) -> DataFrame:
    """Peaks cut at the sample numbers that the algorithm finds in ``data``; those with less area than ``min_area`` stay whole.

    Each round cuts the pieces of the one before, ``iterations`` times.  Time,
    endtime, length, data and area are those of the piece; ``piece`` numbers
    them from 0 and other columns are the peak's.
    """
    if algorithm not in SPLITTERS:
        raise TypeError(f"no splitter {algorithm}; there are {sorted(SPLITTERS)}")
    for _ in range(iterations):
        found = F.when(F.col("area") >= min_area, SPLITTERS[algorithm](F.col("data"), **options))
        inner = F.array_distinct(F.filter(F.coalesce(found, F.array().cast("array<int>")), lambda i: (i > 0) & (i < F.col("length"))))
        edges = F.concat(F.array(F.lit(0)), F.array_sort(inner), F.array(F.col("length").cast("int")))
        cut = peaks.withColumn("__edges", edges).select("*", F.explode(F.arrays_zip(F.slice("__edges", 1, F.size("__edges") - 1).alias("low"), F.slice("__edges", 2, F.size("__edges") - 1).alias("high"))).alias("__cut"))
        time = F.col("time") + F.col("__cut.low") * F.col("dt")
        cut = cut.withColumn("data", F.slice("data", F.col("__cut.low") + 1, F.col("__cut.high") - F.col("__cut.low"))).withColumn("length", F.col("__cut.high") - F.col("__cut.low"))
        peaks = cut.withColumn("time", time).withColumn("endtime", F.col("time") + F.col("length").cast("long") * F.col("dt")).withColumn("area", W.total(F.col("data"))).drop("__edges", "__cut")
    return peaks.withColumn("piece", (F.row_number().over(Window.partitionBy(*PEAK).orderBy("time")) - 1).cast("int"))


def add_lone_hits(peaks: DataFrame, hits: DataFrame, gains: DataFrame, width: int) -> DataFrame:
    """``peaks`` with the scaled areas of the hits that they hold whole added to area, to area_per_channel, and to the sample in which each hit begins."""
    pairs = overlap_pairs(with_gain(hits, gains).select("run_id", "channel", "time", "endtime", "area", "gain"), peaks.select("run_id", "peak", "time", "endtime", "dt"), width)
    inside = pairs.where("b_time <= a_time AND a_endtime <= b_endtime").select(F.col("b_run_id").alias("run_id"), F.col("b_peak").alias("peak"), F.col("a_channel").alias("channel"), (F.col("a_area") * F.col("a_gain")).alias("y"), F.floor((F.col("a_time") - F.col("b_time")) / F.col("b_dt")).cast("int").alias("i"))
    sums = lambda key: inside.groupBy(*PEAK, key).agg(F.sum("y").alias("y")).groupBy(*PEAK)
    places = sums("i").agg(F.collect_list(F.struct("i", F.col("y").alias("x"))).alias("__places"))
    channels = sums("channel").agg(F.sum("y").alias("__all"), F.map_from_entries(F.collect_list(F.struct("channel", "y"))).alias("__channels"))
    out = peaks.join(places, PEAK, "left").join(channels, PEAK, "left")
    some = F.col("__all").isNotNull()
    added = W.placed(F.filter("__places", lambda s: s["i"] < F.size("data")), F.size("data"), F.lit(0.0))
    out = out.withColumn("data", F.when(some, F.zip_with("data", added, lambda x, y: x + y)).otherwise(F.col("data").cast("array<double>")))
    both = F.map_zip_with("area_per_channel", "__channels", lambda k, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    out = out.withColumn("area_per_channel", F.when(some, both).otherwise(F.col("area_per_channel")))
    return out.withColumn("area", F.col("area") + F.coalesce("__all", F.lit(0.0))).drop("__places", "__channels", "__all")


def integration_bounds(hits: DataFrame, before: int, after: int, excluded: DataFrame | None = None) -> DataFrame:
    """``low`` and ``high`` in ns: hits extended by ``before`` and ``after``, within their record (record_time, record_endtime), off the ``excluded`` intervals, and without overlap in a channel.

    Where two extensions meet, the later hit yields, but no hit loses a part of
    itself; nor does an excluded interval take one from it.
    """
    low, high = F.greatest(F.col("time") - before, F.col("record_time")), F.least(F.col("endtime") + after, F.col("record_endtime"))
    rows = hits
    if excluded is not None:
        ends = excluded.select("run_id", F.col("endtime").alias("k"), F.lit(0).alias("src"))
        starts = excluded.select("run_id", F.col("time").alias("k"), F.lit(0).alias("src"))
        for name, points, at, pick in (("__end", ends, "time", F.max), ("__start", starts, "endtime", F.min)):
            every = rows.withColumn("k", F.col(at)).withColumn("src", F.lit(1)).unionByName(points, allowMissingColumns=True)
            order = Window.partitionBy("run_id").orderBy(F.col("k") if pick is F.max else F.col("k").desc(), "src").rowsBetween(Window.unboundedPreceding, 0)
            rows = every.withColumn(name, pick(F.when(F.col("src") == 0, F.col("k"))).over(order)).where("src = 1").drop("k", "src")
        low, high = F.greatest(low, "__end"), F.least(high, "__start")
    order = Window.partitionBy("run_id", "channel").orderBy("time", "endtime", "row_id")
    rows = rows.withColumn("low", low).withColumn("high", F.least(high, F.greatest(F.lead("time").over(order), F.col("endtime"))))
    return rows.withColumn("low", F.greatest("low", F.least(F.lag("high").over(order), F.col("time")))).drop("__end", "__start")


def integrate_hits(bounded: DataFrame, records: DataFrame) -> DataFrame:
    """``area`` of hits between ``low`` and ``high`` in their record, with the part of the baseline below one for each sample."""
    source = records.select(F.col("run_id").alias("__r"), F.col("row_id").alias("__id"), F.col("time").alias("__t0"), F.col("dt").alias("__dt"), F.col("data").alias("__data"), F.col("baseline").alias("__base"))
    rows = bounded.join(source, (F.col("run_id") == F.col("__r")) & (F.col("record_id") == F.col("__id")))
    first, last = F.floor((F.col("low") - F.col("__t0")) / F.col("__dt")).cast("int"), F.floor((F.col("high") - F.col("__t0")) / F.col("__dt")).cast("int")
    area = F.aggregate(F.slice("__data", first + 1, last - first), F.lit(0.0), lambda a, x: a + x) + (F.col("__base") - F.floor("__base")) * (last - first)
    return rows.withColumn("area", area).drop("__r", "__id", "__t0", "__dt", "__data", "__base")


def hitlets_from_hits(hits: DataFrame, before: int, after: int, channels: tuple[int, int] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Joined hits of the channels from the first to the last of the range, by time: run_id, channel, time, endtime, n."""
    rows = hits if channels is None else hits.where(F.col("channel").between(*channels))
    return joined_hits(rows, before, after, start, end)


def hitlet_data(hitlets: DataFrame, records: DataFrame, gains: DataFrame, width: int, dt: int = 1) -> DataFrame:
    """Hitlets (with ``peak``, an id) cut to what records of their channel cover, with the scaled samples there: time, endtime, length, dt, data, area.

    A place between two records is 0; a hitlet without any record, or an empty one, goes.
    """
    source = with_gain(records.withColumn("endtime", F.col("time") + F.col("length").cast("long") * F.col("dt")), gains)
    pairs = overlap_pairs(source, hitlets.where("endtime > time").select(*PEAK, "channel", "time", "endtime"), width, 0, ["run_id", "channel"])
    covered = pairs.groupBy(F.col("b_run_id").alias("run_id"), F.col("b_peak").alias("peak")).agg(F.min(F.greatest("a_time", "b_time")).alias("__t"), F.max(F.least("a_endtime", "b_endtime")).alias("__e"))
    rest = [c for c in hitlets.columns if c not in ("time", "endtime", "length", "dt", "data", "area")]
    cut = hitlets.select(*rest).join(covered, PEAK).withColumnsRenamed({"__t": "time", "__e": "endtime"}).withColumn("dt", F.lit(dt)).withColumn("length", ((F.col("endtime") - F.col("time")) / dt).cast("int"))
    pairs = pairs.drop("b_time", "b_endtime").join(cut.select(F.col("run_id").alias("b_run_id"), F.col("peak").alias("b_peak"), F.col("time").alias("b_time"), F.col("dt").alias("b_dt"), F.col("length").alias("b_length")), ["b_run_id", "b_peak"])
    return _gathered(cut, _samples(pairs, F.lit(0), F.col("a_length")).withColumn("y", F.col("__x") * F.col("a_gain")), 0).drop("area_per_channel")


def cut_outside_hits(records: DataFrame, hits: DataFrame, width: int, before: int = 2, after: int = 15) -> DataFrame:
    """Records whose samples farther than ``before`` and ``after`` samples from all hits of their channel are 0; hits of neighbouring fragments count."""
    dt = F.col("dt")
    spans = hits.select("run_id", "channel", (F.col("time") - before * dt).alias("time"), (F.col("endtime") + after * dt).alias("endtime"))
    whole = records.select("run_id", "channel", "row_id", "time", (F.col("time") + F.col("length").cast("long") * dt).alias("endtime"))
    near = overlap_pairs(whole, spans, width, 0, ["run_id", "channel"]).groupBy(F.col("a_run_id").alias("run_id"), F.col("a_row_id").alias("row_id")).agg(F.collect_set(F.struct("b_time", "b_endtime")).alias("__spans"))
    at = lambda i: F.col("time") + i.cast("long") * dt
    kept = F.transform("data", lambda x, i: F.when(F.exists("__spans", lambda s: (at(i) >= s["b_time"]) & (at(i) < s["b_endtime"])), x).otherwise(F.lit(0)))
    out = records.join(near, ["run_id", "row_id"], "left")
    return out.withColumn("data", F.when(F.col("__spans").isNotNull(), kept).otherwise(F.transform("data", lambda x: F.lit(0)))).drop("__spans")


def raw_to_records(raw: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``raw`` in the columns and types of ``fields``; those that it lacks are null."""
    return raw.select(*[(F.col(name) if name in raw.columns else F.lit(None)).cast(kind).alias(name) for name, kind in fields.items()])


def carried_baseline(records: DataFrame, samples: int) -> DataFrame:
    """``baseline`` and ``baseline_rms`` from the first samples of each pulse's fragment 0, kept for the channel's later fragments till the next one."""
    order = Window.partitionBy("run_id", "channel").orderBy("time", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("record_i") == 0, W.baseline_of(F.col("data"), samples))
    rows = records.withColumn("__b", F.last(own, ignorenulls=True).over(order))
    return rows.withColumn("baseline", F.col("__b.mean")).withColumn("baseline_rms", F.col("__b.rms")).drop("__b")
