"""Expressions on array columns that hold sampled waveforms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def total(data: Column) -> Column:
    return F.aggregate(data, F.lit(0).cast("double"), lambda a, x: a + x)


def zero_out_of_bounds(data: Column, length: Column) -> Column:
    return F.transform(data, lambda x, i: F.when(i < length, x).otherwise(F.lit(0)))


def integrate(data: Column, length: Column, shift: Column, baseline: Column) -> Column:
    """Sum of samples times 2**shift, and the part of the baseline below one for each sample, rounded half to even."""
    rest = baseline - F.floor(baseline)
    return (F.aggregate(data, F.lit(0).cast("long"), lambda a, x: a + x) * F.pow(F.lit(2), shift).cast("long") + F.bround(rest * length).cast("long")).cast("long")


def subtract_baseline(data: Column, length: Column, baseline: Column, flip: bool = True) -> Column:
    sign = -1 if flip else 1
    return F.transform(data, lambda x, i: F.when(i < length, sign * (x - baseline.cast("int"))).otherwise(x))


def baseline_of(data: Column, samples: int) -> Column:
    """Struct of mean and population standard deviation of the first samples."""
    head = F.slice(data, 1, samples)
    n = F.size(head)
    mean = total(head) / n
    return F.struct(mean.alias("mean"), F.sqrt(F.aggregate(head, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n).alias("rms"))


def cut_baseline(data: Column, record_i: Column, pulse_length: Column, samples: int, before: int, after: int) -> Column:
    """Zero the first ``before`` samples of a pulse and those from ``after`` before its end on."""
    place = lambda i: record_i * samples + i
    return F.transform(data, lambda x, i: F.when((place(i) >= before) & (place(i) < pulse_length - after), x).otherwise(F.lit(0)))


def downsample(data: Column, length: Column, limit: int) -> Column:
    """Struct of data, length and factor: blocks of ceil(length / limit) samples summed, the incomplete last one dropped."""
    factor = F.ceil(length / F.lit(limit)).cast("int")
    blocks = F.floor(length / factor).cast("int")
    sums = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.aggregate(F.slice(data, i * factor + 1, factor), F.lit(0).cast("double"), lambda a, x: a + x))
    return F.struct(F.when(blocks > 0, sums).otherwise(F.array().cast("array<double>")).alias("data"), blocks.alias("length"), factor.alias("factor"))


def index_of_fraction(data: Column, length: Column, fraction: float) -> Column:
    """Place in samples, with interpolation, at which this share of the area is reached; 0 without area, ``length`` for 1."""
    if fraction == 1:
        return F.when(total(data) > 0, length.cast("double")).otherwise(F.lit(0.0))
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("at"), F.lit(0).alias("i"))

    def find(area: Column) -> Column:
        goal = area * fraction

        def step(s: Column, x: Column) -> Column:
            here = (s["at"] < 0) & (s["sum"] + x >= goal)
            at = F.when(here, s["i"] + F.when(x != 0, (goal - s["sum"]) / x).otherwise(F.lit(0.0))).otherwise(s["at"])
            return F.struct((s["sum"] + x).alias("sum"), at.alias("at"), (s["i"] + 1).alias("i"))

        return F.when(area > 0, F.greatest(F.aggregate(data, state, step, lambda s: s["at"]), F.lit(0.0))).otherwise(F.lit(0.0))

    return F.element_at(F.transform(F.array(total(data)), find), 1)  # the array binds the area to a name, so that it is summed once


def places_of_fractions(data: Column, length: Column, fractions: list[float]) -> Column:
    """``index_of_fraction`` of many fractions, in one pass over the samples."""
    shares = np.array(fractions, float)

    @F.pandas_udf("array<double>")
    def places(rows: pd.Series, lengths: pd.Series) -> pd.Series:
        out = []
        for row, n in zip(rows, lengths, strict=True):
            x = np.asarray(row if row is not None else [], float)
            sums = np.cumsum(x)
            if not len(x) or not sums[-1] > 0:
                out.append(np.zeros(len(shares)))
                continue
            goal = sums[-1] * shares
            at = np.minimum(np.searchsorted(np.maximum.accumulate(sums), goal, side="left"), len(x) - 1)
            before = np.where(at > 0, sums[at - 1], 0.0)
            step = np.where(x[at] != 0, x[at], 1.0)
            out.append(np.where(shares == 1, float(n), np.maximum(at + np.where(x[at] != 0, (goal - before) / step, 0.0), 0.0)))
        return pd.Series(out)

    return places(data, length)


def widths(data: Column, length: Column, dt: Column, n: int = 11) -> Column:
    """Struct of median_time, width[] and area_decile_from_midpoint[] in ns: widths hold the shares i / (n - 1) around the middle."""
    shares = [i / (n - 1) for i in range(n)]
    wanted = sorted({q for s in shares for q in (s, 0.5 + s / 2, 0.5 - s / 2)} | {0.5})

    def parts(found: Column) -> Column:
        at = lambda q: F.get(found, F.lit(wanted.index(q))) * dt
        return F.struct(
            at(0.5).alias("median_time"),
            F.array(*[at(0.5 + s / 2) - at(0.5 - s / 2) if s else F.lit(0.0) for s in shares]).alias("width"),
            F.array(*[at(s) - at(0.5) for s in shares]).alias("area_decile_from_midpoint"),
        )

    return F.element_at(F.transform(F.array(places_of_fractions(data, length, wanted)), parts), 1)


def centre_time(data: Column, time: Column, endtime: Column, dt: Column) -> Column:
    """Mean time of the area: sample middles weighted, floored and kept in the interval; the start without area."""
    area = total(data)
    moment = F.aggregate(F.transform(data, lambda x, i: x * (i + 0.5)), F.lit(0.0), lambda a, x: a + x)
    return F.when(area != 0, F.least(F.greatest(time + F.floor(moment / area * dt), time), endtime)).otherwise(time).cast("long")


def fraction_top(per_channel: Column, n_top: int) -> Column:
    area = total(per_channel)
    return F.when(area > 0, total(F.slice(per_channel, 1, n_top)) / area).otherwise(F.lit(float("nan")))


def moving_average(data: Column, wing: int) -> Column:
    """Mean over samples i - wing to i + wing, cut at the ends."""
    return F.transform(data, lambda x, i: (lambda part: total(part) / F.size(part))(F.slice(data, F.greatest(i - wing, F.lit(0)) + 1, F.least(i + wing, F.size(data) - 1) - F.greatest(i - wing, F.lit(0)) + 1)))


def squared_deviations(data: Column) -> Column:
    """For each sample, the weighted squared deviation of the sample numbers up to it; weights are the samples, 0 at least."""
    state = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"), F.lit(0).alias("i"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        y = F.greatest(x.cast("double"), F.lit(0.0))
        w, m, q = s["w"] + y, s["m"] + y * s["i"], s["q"] + y * s["i"] * s["i"]
        return F.struct(w.alias("w"), m.alias("m"), q.alias("q"), (s["i"] + 1).alias("i"), F.concat(s["out"], F.array(F.when(w > 0, q - m * m / w).otherwise(F.lit(0.0)))).alias("out"))

    return F.aggregate(data, state, step, lambda s: s["out"])


def goodness_of_split(data: Column) -> Column:
    """For each sample, 1 - (deviations left of it + deviations from it on) / all."""
    both = F.array(F.struct(squared_deviations(data).alias("left"), F.reverse(squared_deviations(F.reverse(data))).alias("right")))

    def share(s: Column) -> Column:
        whole = F.element_at(s["left"], -1)
        return F.zip_with(s["left"], s["right"], lambda a, b: F.when(whole > 0, 1 - (a + b) / whole).otherwise(F.lit(0.0)))

    return F.element_at(F.transform(both, share), 1)  # the one-element array binds both to a name, so that each is computed once


def find_hits(records: DataFrame, threshold: Column, row_id: str = "row_id", keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Maximal runs of samples at or above the threshold: left, right, time, endtime, area, height, max_sample (the first maximum).

    Both edges of all runs are found within the array, and only hits become
    rows: nothing is shuffled.  A null sample or threshold is in no hit.
    """
    over = lambda i: F.coalesce((i >= 0) & (i < F.col("length")) & (F.get("data", i) >= threshold), F.lit(False))
    places = F.sequence(F.lit(0), F.col("length").cast("int") - 1)
    left = F.filter(places, lambda i: over(i) & ~over(i - 1))
    right = F.transform(F.filter(places, lambda i: over(i) & ~over(i + 1)), lambda i: i + 1)
    spans = F.explode(F.arrays_zip(left.alias("left"), right.alias("right")))
    rows = records.where("length > 0").select(*keys, row_id, "time", "dt", "data", spans.alias("s")).select("*", "s.left", "s.right")
    rows = rows.withColumn("data", F.slice("data", F.col("left") + 1, F.col("right") - F.col("left"))).withColumn("height", F.array_max("data"))
    whole = isinstance(records.schema["data"].dataType.elementType, T.IntegralType)
    area = F.aggregate("data", F.lit(0).cast("long") if whole else F.lit(0.0), lambda a, x: a + x)
    first = F.col("left") + F.array_position("data", F.col("height")).cast("int") - 1
    return rows.select(*keys, row_id, "left", "right", (F.col("time") + F.col("left") * F.col("dt")).alias("time"), (F.col("time") + F.col("right") * F.col("dt")).alias("endtime"), area.alias("area"), "height", first.alias("max_sample"))


def placed(entries: Column, n: Column, zero: Column) -> Column:
    """Array of ``n`` values: ``zero`` but at the places of ``entries``, structs of a place i from 0 to n - 1, each once, and a value x.

    Entries are sorted and the zeros between them filled in, so it takes no
    longer than the array is, but for the sorting.  Null entries are none.
    """
    zeros = lambda k: F.array_repeat(zero, k)

    def fill(e: Column) -> Column:
        behind = lambda j: F.coalesce(F.get(e, j - 1)["i"], F.lit(-1)) + 1
        return F.concat(F.flatten(F.transform(e, lambda s, j: F.concat(zeros(s["i"] - behind(j)), F.array(F.coalesce(s["x"], zero))))), zeros(n - behind(F.size(e))))

    return F.coalesce(F.get(F.transform(F.array(F.sort_array(entries)), fill), F.lit(0)), zeros(n))


def sum_waveform(pieces: DataFrame, keys: list[str], length: str, start: str) -> DataFrame:
    """Arrays ``data`` of rows with the same keys added up, each from sample ``start`` on, in an array of ``length`` samples."""
    samples = pieces.select(*keys, F.col(length).alias("__n"), (F.col(start)).alias("__start"), F.posexplode("data").alias("pos", "x")).withColumn("i", F.col("__start") + F.col("pos")).where("i >= 0 AND i < __n")
    sums = samples.groupBy(*keys, "__n", "i").agg(F.sum("x").alias("x"))
    lists = sums.groupBy(*keys, "__n").agg(F.collect_list(F.struct("i", "x")).alias("__e"))
    return lists.select(*keys, placed(F.col("__e"), F.col("__n"), F.lit(0).cast(sums.schema["x"].dataType)).alias("data"))


def conditional_entropy(data: Column, template: Column | None = None) -> Column:
    """Minus the sum of p ln(p / q) over samples with p > 0, p being the samples' shares and q the template's or equal ones; NaN without area."""
    area = total(data)
    share = F.transform(data, lambda x: x / area)
    if template is None:
        terms = F.transform(F.filter(share, lambda p: p > 0), lambda p: p * F.log(p * F.size(data)))
    else:
        whole = total(template)
        terms = F.transform(F.filter(F.zip_with(share, template, lambda p, t: F.struct(p.alias("p"), (t / whole).alias("q"))), lambda s: s["p"] > 0), lambda s: s["p"] * F.log(s["p"] / s["q"]))
    return F.when(area > 0, -total(terms)).otherwise(F.lit(float("nan")))


def full_width(data: Column, fraction: float) -> Column:
    """Struct of left and right edge in samples, interpolated, where the waveform falls below this share of its first maximum; NaN where it doesn't."""
    top = F.array_max(data)
    peak = F.array_position(data, top).cast("int") - 1
    level = top * fraction
    below_left = F.aggregate(F.transform(F.slice(data, F.lit(1), peak), lambda x, i: F.when(x < level, i)), F.lit(-1), lambda a, i: F.coalesce(i.cast("int"), a))
    value = lambda i: F.get(data, i).cast("double")
    left = F.when(below_left >= 0, below_left + 0.5 + (level - value(below_left)) / (value(below_left + 1) - value(below_left)))
    tail = F.transform(data, lambda x, i: F.when((i > peak) & (x < level), i))
    first = F.array_min(F.filter(tail, lambda i: i.isNotNull())).cast("int")
    right = F.when(first.isNotNull(), first - 0.5 + (value(first - 1) - level) / (value(first - 1) - value(first)))
    nan = F.lit(float("nan"))
    return F.when(top > 0, F.struct(F.coalesce(left, nan).alias("left"), F.coalesce(right, nan).alias("right"))).otherwise(F.struct(nan.alias("left"), nan.alias("right")))


def highest_density(data: Column, fraction: float) -> Column:
    """Sample numbers of the smallest set of highest samples that holds this share of the area, ascending."""
    order = F.array_sort(F.transform(data, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    goal = total(data) * fraction
    state = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("took"))
    step = lambda s, e: F.when(s["sum"] < goal, F.struct((s["sum"] - e["x"]).alias("sum"), F.concat(s["took"], F.array(e["i"])).alias("took"))).otherwise(s)
    return F.array_sort(F.aggregate(order, state, step, lambda s: s["took"]))


def local_minimum_splits(data: Column, min_height: float, min_ratio: float) -> Column:
    """Sample numbers of minima at which a waveform is split: the maxima on both sides exceed them by height and by ratio."""
    state = F.struct(F.lit(float("-inf")).alias("top"), F.lit(float("inf")).alias("low"), F.lit(-1).alias("at"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        x = x.cast("double")
        need = lambda m: F.greatest(m + min_height, m * min_ratio)
        split = (s["at"] >= 0) & (x > need(s["low"]))
        falls = x < s["low"]
        dip = falls & (s["top"] > need(x))
        return F.struct(
            F.when(split, x).otherwise(F.greatest(s["top"], x)).alias("top"),
            F.when(split, F.lit(float("inf"))).when(falls, x).otherwise(s["low"]).alias("low"),
            F.when(split, F.lit(-1)).when(dip, s["i"]).when(falls, F.lit(-1)).otherwise(s["at"]).alias("at"),
            (s["i"] + 1).alias("i"),
            F.when(split, F.concat(s["out"], F.array(s["at"]))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(data, state, step, lambda s: s["out"])


def hitlet_properties(data: Column, length: Column, dt: Column) -> Column:
    """Struct of amplitude, its time (the first maximum), and in ns the 10 % and 25 % area times and the widths of the middle 50 % and 80 %; all 0 without samples other than 0."""
    top = F.array_max(data)
    at = lambda q: index_of_fraction(data, length, q) * dt
    some = F.exists(data, lambda x: x != 0)
    zero = lambda c: F.when(some, c).otherwise(F.lit(0)).cast("double")
    return F.struct(
        zero(top).alias("amplitude"),
        F.when(some, (F.array_position(data, top) - 1) * dt).otherwise(F.lit(0)).cast("long").alias("time_amplitude"),
        zero(at(0.25)).alias("left_area"),
        zero(at(0.1)).alias("low_left_area"),
        zero(at(0.75) - at(0.25)).alias("range_50p_area"),
        zero(at(0.9) - at(0.1)).alias("range_80p_area"),
    )


def filter_waveforms(records: DataFrame, taps: list[float], pulse: list[str], fragment: str = "record_i") -> DataFrame:
    """``data`` convolved with an impulse response of odd length, its origin at the first maximum.

    Fragments of a pulse that follow each other get what spills over from their
    neighbours; beyond them are zeros.  All fragments have as many samples, at
    least as many as there are taps.
    """
    if len(taps) % 2 == 0:
        raise ValueError("the impulse response has an odd length")
    origin, behind = taps.index(max(taps)), len(taps) - 1 - taps.index(max(taps))
    order = Window.partitionBy(*pulse).orderBy(fragment)
    beside = lambda f, step: F.when(f(fragment).over(order) == F.col(fragment) + step, f("data").over(order))
    none = lambda n: F.array_repeat(F.lit(0.0), n)
    wide = F.concat(
        F.coalesce(F.slice(F.col("__before"), -behind, behind).cast("array<double>"), none(behind)) if behind else none(0),
        F.col("data").cast("array<double>"),
        F.coalesce(F.slice(F.col("__after"), 1, origin).cast("array<double>"), none(origin)),
    )
    out = F.transform("data", lambda _, i: sum((F.get(F.col("__wide"), i + origin + behind - k) * F.lit(float(t)) for k, t in enumerate(taps)), F.lit(0.0)))
    rows = records.withColumns({"__before": beside(F.lag, -1), "__after": beside(F.lead, 1)}).withColumn("__wide", wide)
    return rows.withColumn("data", out).drop("__before", "__after", "__wide")


#: Samples of merged peaks that a worker holds at once; a longer peak is held alone.
MERGED_SAMPLES = 1 << 20


def _spread(rows: pa.RecordBatch) -> pa.ListArray:
    """The merged waveforms of rows with __at, __cuts and __sizes (lists with an entry for each piece) and __x (the pieces' samples on end)."""
    numbers = lambda name: rows.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    at, cuts, sizes = numbers("__at"), numbers("__cuts"), numbers("__sizes")
    x = rows.column("__x").flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
    lengths = rows.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    row = np.repeat(np.arange(rows.num_rows), rows.column("__at").value_lengths().to_numpy(zero_copy_only=False))
    fine = sizes * cuts
    place = np.arange(fine.sum()) + np.repeat(at - (np.cumsum(fine) - fine), fine)
    each = np.repeat(cuts, sizes)
    spread = np.repeat(x / each, each)
    inside = (place >= 0) & (place < np.repeat(lengths[row], fine))
    place += np.repeat(begins[row], fine)
    data = np.bincount(place[inside], spread[inside], begins[-1]) if inside.any() else np.zeros(begins[-1])
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(data, pa.float64()))


def _spread_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(batch.column("length").to_numpy(zero_copy_only=False), dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            most = (ends[low - 1] if low else 0) + MERGED_SAMPLES
            high = max(low + 1, int(np.searchsorted(ends, most, "right")))
            rows = batch.slice(low, high - low)
            kept = [n for n in batch.schema.names if not n.startswith("__")]
            yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in kept], _spread(rows)], [*kept, "data"])
            low = high


def merge_peaks(peaks: DataFrame, group: list[str]) -> DataFrame:
    """One peak for the disjoint peaks of each group: time, dt (the greatest common divisor), length, endtime, data, area, n_hits, n.

    Samples are cut to the common dt and spread evenly over the cuts.  Needs
    time, dt, length, data, area and n_hits.  A group is a handful of peaks:
    they are gathered in one row, and each sample is moved to its place once.
    """
    dts, end = F.collect_set("dt"), F.col("time") + F.col("length").cast("long") * F.col("dt")
    data = F.slice("data", F.lit(1), F.col("length")).cast("array<double>")
    piece = F.when(F.col("time").isNotNull() & F.col("dt").isNotNull() & (F.size(data) > 0), F.struct("time", "dt", data.alias("data")))
    sums = [F.sum("area").alias("area"), F.sum("n_hits").alias("n_hits"), F.count(F.lit(1)).alias("n")]
    whole = peaks.dropna(subset=group).groupBy(*group).agg(F.min("time").alias("time"), F.max_by(end, F.struct("time", end)).alias("endtime"), dts.alias("__dts"), *sums, F.collect_list(piece).alias("__pieces"))
    common = F.array_max(F.filter(F.sequence(F.lit(1), F.array_min("__dts").cast("int")), lambda d: F.forall("__dts", lambda x: x % d == 0)))
    whole = whole.withColumn("dt", common).withColumn("length", F.floor((F.col("endtime") - F.col("time")) / F.col("dt")).cast("int")).where((F.size("__pieces") > 0) & (F.col("length") > 0))
    of = lambda value: F.transform("__pieces", value)
    rows = whole.drop("__dts", "__pieces").columns
    ready = whole.select(
        *rows,
        of(lambda p: ((p["time"] - F.col("time")) / F.col("dt")).cast("int")).alias("__at"),
        of(lambda p: (p["dt"] / F.col("dt")).cast("int")).alias("__cuts"),
        of(lambda p: F.size(p["data"])).alias("__sizes"),
        F.flatten("__pieces.data").alias("__x"),
    )
    return ready.mapInArrow(_spread_batches, T.StructType([*ready.select(*rows).schema.fields, T.StructField("data", T.ArrayType(T.DoubleType()))]))


def natural_break(data: Column, threshold: float, wing: int = 0, low: bool = False) -> Column:
    """The sample number of the best split, in an array, if its goodness is over the threshold; else an empty one.

    With ``low`` the goodness is scaled down at high samples: by one minus the
    share of the maximum of the waveform, smoothed over ``wing`` samples on
    either side.
    """
    found = goodness_of_split(data)
    if low:
        smooth = moving_average(data, wing) if wing else F.transform(data, lambda x: x.cast("double"))
        found = F.element_at(F.transform(F.array(F.struct(found.alias("g"), smooth.alias("s"))), lambda b: F.zip_with(b["g"], b["s"], lambda g, s: g * (1 - s / F.array_max(b["s"])))), 1)
    best = F.transform(F.array(found), lambda g: F.when(F.array_max(g) > threshold, F.array((F.array_position(g, F.array_max(g)) - 1).cast("int"))).otherwise(F.array().cast("array<int>")))
    return F.element_at(best, 1)


def _region(x: np.ndarray, fraction: float, upper: bool) -> tuple[np.ndarray, float]:
    """Samples of the smallest region above one level that holds the fraction of the area, and that level; all samples if none above the lowest does."""
    order = np.argsort(-x, kind="stable")
    high, n = x[order], len(x)
    j = np.arange(1, n)
    lowest = high[1:] if upper else np.zeros(n - 1)
    sums = np.cumsum(high)[:-1]
    seen = (sums - j * lowest) / high.sum()
    fits = np.flatnonzero((seen >= fraction) & ((j == 1) | (high[1:] != high[:-1])))
    if not len(fits):
        return np.arange(n), (1 - fraction) * float(x.sum()) / n
    k = fits[0]
    share = fraction / seen[k]
    return np.sort(order[: k + 1]), float((1 - share) * sums[k] / j[k] + share * lowest[k])


def density_regions(data: Column, fractions: list[float], upper: bool = False) -> Column:
    """For each fraction a struct of left[], right[] (the runs of samples of the highest density region, half-open) and height.

    With ``upper`` only the area above the region's level counts.  Null or empty
    waveforms, and those without area, have no runs and height NaN.
    """

    @F.pandas_udf("array<struct<left: array<int>, right: array<int>, height: double>>")
    def regions(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            x = np.asarray(row if row is not None else [], float)
            found = []
            for fraction in fractions:
                places, height = _region(x, fraction, upper) if x.sum() > 0 else (np.zeros(0, int), float("nan"))
                cuts = np.flatnonzero(np.diff(places) > 1)
                left = places[np.concatenate([[0], cuts + 1])] if len(places) else places
                right = places[np.concatenate([cuts, [len(places) - 1]])] + 1 if len(places) else places
                found.append({"left": left.tolist(), "right": right.tolist(), "height": height})
            out.append(found)
        return pd.Series(out)

    return regions(data)


def density_width(data: Column, fractions: list[float], dt: Column, interpolate: bool = False) -> Column:
    """For each fraction a struct of left and right: the outer edges of the region of the samples over 0, with ``interpolate`` where the waveform crosses the region's level; NaN without area."""
    x = F.transform(data, lambda v: F.greatest(v.cast("double"), F.lit(0.0)))
    at = lambda i: F.coalesce(F.get(x, i), F.lit(0.0))
    nan = F.lit(float("nan"))

    def edges(r: Column) -> Column:
        first, last = F.get(r["left"], F.lit(0)), F.element_at(r["right"], -1) - 1
        low, high = first.cast("double"), last + F.lit(1.0)
        if interpolate:
            low = first + 0.5 - (at(first) - r["height"]) / (at(first) - F.when(first > 0, at(first - 1)).otherwise(0.0))
            high = last + 0.5 + (at(last) - r["height"]) / (at(last) - at(last + 1))
        some = F.size(r["left"]) > 0
        return F.struct(F.when(some, low * dt).otherwise(nan).alias("left"), F.when(some, high * dt).otherwise(nan).alias("right"))

    return F.transform(density_regions(x, fractions, True), edges)
