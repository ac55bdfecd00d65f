"""Interval algebra on DataFrames with ``run_id``, ``time`` and ``endtime``.

Interval joins are equi-joins on (run, time bin) with a residual condition; each
pair is kept in the one bin where both begin to be there, so nothing has to be
made distinct afterwards.  A bin is about as long as a typical interval.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[str]


def _order(keys: Keys, *columns: str):
    return Window.partitionBy(*keys).orderBy(*columns)


def _bins(df: DataFrame, low: Column, high: Column, width: int) -> DataFrame:
    """A row for each bin that the closed range [low, high] has a part of."""
    floor = lambda c: ((c - F.pmod(c, F.lit(width))) / width).cast("long")
    return df.withColumn("__low_bin", floor(low)).withColumn("__bin", F.explode(F.sequence(F.col("__low_bin"), F.greatest(F.col("__low_bin"), floor(high)))))


def overlap_pairs(a: DataFrame, b: DataFrame, width: int, window: int = 0, keys: Keys | None = None, how: str = "inner") -> DataFrame:
    """Rows of ``a`` and ``b`` (columns prefixed a_ and b_) with a.endtime > b.time - window and a.time < b.endtime + window.

    That is all: an empty interval counts where it lies inside another, not at its edges.
    ``how``: inner, or left_semi and left_anti, which return rows of ``a``.
    """
    keys = keys or ["run_id"]
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns])
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]).withColumn("__from", F.col("b_time") - window).withColumn("__to", F.col("b_endtime") + window)
    left = _bins(left, F.col("a_time"), F.col("a_endtime") - 1, width)
    right = _bins(right, F.col("__from"), F.col("__to") - 1, width).withColumnRenamed("__bin", "__bin_b").withColumnRenamed("__low_bin", "__low_bin_b")
    same = (F.col("__bin") == F.col("__bin_b")) & (F.col("a_endtime") > F.col("__from")) & (F.col("a_time") < F.col("__to"))
    for key in keys:
        same &= F.col(f"a_{key}") == F.col(f"b_{key}")
    once = F.col("__bin") == F.greatest("__low_bin", "__low_bin_b")
    if how == "inner":
        return left.join(right, same & once).drop("__bin", "__bin_b", "__low_bin", "__low_bin_b", "__from", "__to")
    # whether a row touches depends on its keys and bounds alone, so repeated rows and nulls elsewhere don't matter
    bounds = [*keys, "time", "endtime"]
    touched = left.join(right, same, "left_semi").select(*[F.col(f"a_{c}").alias(f"__t_{c}") for c in bounds]).distinct()
    return a.join(touched, _same(bounds, "__t_"), how)


def _same(columns: Keys, prefix: str) -> Column:
    """Null-safe equality of columns and their prefixed twins."""
    same = F.lit(True)
    for c in columns:
        same &= F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return same


def running(df: DataFrame, keys: Keys, order: Keys, pick: Callable, value: Column, name: str, before: bool = False, cell: str = "__cell") -> DataFrame:
    """``name``: ``pick`` (max or sum) of ``value`` over the rows of the same keys up to each, or before it.

    Two levels, so that no task sees a whole key: within each ``cell`` (a
    column that ascends with the order) by a window, and over the cells before
    by a window over one row a cell.
    """
    inside = df.withColumn("__v", value).withColumn(name, pick("__v").over(Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)))
    cells = inside.groupBy(*keys, cell).agg(pick("__v").alias("__all"))
    carried = pick("__all").over(Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(*[F.col(c).alias(f"__c_{c}") for c in [*keys, cell]], carried.alias("__carried"))
    both = F.greatest(name, "__carried") if pick is F.max else F.coalesce(F.col(name) + F.col("__carried"), name, "__carried")
    return inside.join(cells, _same([*keys, cell], "__c_")).withColumn(name, both).drop("__v", "__carried", *[f"__c_{c}" for c in [*keys, cell]])


#: Nanoseconds of a cell of the two-level windows.
CELL = 3_600_000_000_000


def _celled(df: DataFrame, column: str = "time") -> DataFrame:
    return df.withColumn("__cell", F.floor(F.col(column) / CELL))


def group_starts(df: DataFrame, gap: int, left: int = 0, right: int = 0, keys: Keys | None = None, max_duration: int | None = None) -> DataFrame:
    """``df`` with ``__group`` and ``__part``: two numbers that the rows of a gap group share, alone among those of the same keys.

    A group begins where the next start is ``gap`` or more after all ends before.
    With ``max_duration`` it is also closed before the row with which it would be
    longer, the extension on the left counting twice; only islands that are too
    long go through a fold, one island at a time.  A row without bounds is in no
    group.
    """
    keys = keys or ["run_id"]
    rows = _celled(df.where("time IS NOT NULL AND endtime IS NOT NULL"))
    rows = running(rows, keys, ["time", "endtime"], F.max, F.col("endtime"), "__before", before=True)
    new = F.when(F.col("__before").isNull() | (F.col("time") - F.col("__before") >= gap), F.col("time"))
    rows = running(rows, keys, ["time", "endtime"], F.max, new, "__group").drop("__before", "__cell").withColumn("__part", F.lit(0).cast("long"))
    if max_duration is None:
        return rows
    spans = rows.groupBy(*keys, "__group").agg((F.max("endtime") - F.min("time") + 2 * left + right).alias("__span"))
    long = spans.where(F.col("__span") > max_duration).select(*[F.col(c).alias(f"__s_{c}") for c in [*keys, "__group"]])
    island = _same([*keys, "__group"], "__s_")
    short = rows.join(long, island, "left_anti")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["time", "endtime"])
        parts, start, end, part = [], None, None, -1
        for t, e in zip(pdf["time"].tolist(), pdf["endtime"].tolist(), strict=True):
            if start is None or t - end >= gap or e - (start - left) + left + right > max_duration:
                start, end, part = t, e, part + 1
            end = max(end, e)
            parts.append(part)
        return pdf.assign(__part=parts)

    return short.unionByName(rows.join(long, island, "left_semi").groupBy(*keys, "__group").applyInPandas(fold, rows.schema))


def gap_groups(df: DataFrame, gap: int, left: int = 0, right: int = 0, keys: Keys | None = None, max_duration: int | None = None) -> DataFrame:
    """(keys, time, endtime, n) of groups of intervals as ``group_starts`` makes them; bounds are extended by ``left`` and ``right``."""
    keys = keys or ["run_id"]
    rows = group_starts(df.select(*dict.fromkeys([*keys, "time", "endtime"])), gap, left, right, keys, max_duration)
    return rows.groupBy(*keys, "__group", "__part").agg((F.min("time") - left).alias("time"), (F.max("endtime") + right).alias("endtime"), F.count(F.lit(1)).alias("n")).drop("__group", "__part")


def containment(things: DataFrame, containers: DataFrame, index: str, width: int, keys: Keys | None = None, row_id: str = "row_id") -> DataFrame:
    """``things`` with ``container``: ``index`` of the container that holds the whole thing, else -1; containers are disjoint."""
    pairs = overlap_pairs(things.select(*(keys or ["run_id"]), row_id, "time", "endtime"), containers, width, 0, keys)
    inside = pairs.where("b_time <= a_time AND a_endtime <= b_endtime AND b_endtime > a_time").groupBy(*[F.col(f"a_{k}").alias(k) for k in keys or ["run_id"]], F.col(f"a_{row_id}").alias(row_id)).agg(F.min(f"b_{index}").alias("container"))
    return things.join(inside, [*(keys or ["run_id"]), row_id], "left").withColumn("container", F.coalesce("container", F.lit(-1)))


def split_by_containment(things: DataFrame, containers: DataFrame, index: str, width: int, keys: Keys | None = None, row_id: str = "row_id") -> DataFrame:
    """``containers`` with ``things``: the ids of what each holds, by time; empty where it holds nothing."""
    keys = keys or ["run_id"]
    held = containment(things, containers, index, width, keys, row_id).where("container >= 0")
    lists = held.groupBy(*keys, F.col("container").alias(index)).agg(F.transform(F.array_sort(F.collect_list(F.struct("time", row_id))), lambda x: x[row_id]).alias("things"))
    return containers.join(lists, [*keys, index], "left").withColumn("things", F.coalesce("things", F.expr("array()").cast(f"array<{things.schema[row_id].dataType.simpleString()}>")))


def touching_windows(things: DataFrame, containers: DataFrame, index: str, window: int = 0, keys: Keys | None = None) -> DataFrame:
    """``containers`` with ``left`` and ``right``: positions in time order of the things from the first that ends after time - window to the last that starts before endtime + window.

    Both are ranks, so they come from one sorted union and no join: ``left``
    counts the things that end up to the container's start (end times in
    order), ``right`` those that start before its end.
    """
    keys = keys or ["run_id"]
    start = containers.select(*keys, index, (F.col("time") - window).alias("k"), F.lit(1).alias("src"))
    end = containers.select(*keys, index, (F.col("endtime") + window).alias("k"), F.lit(0).alias("src"))
    none = F.lit(None).cast(containers.schema[index].dataType).alias(index)
    ended = things.select(*keys, none, F.col("endtime").alias("k"), F.lit(0).alias("src"))
    began = things.select(*keys, none, F.col("time").alias("k"), F.lit(1).alias("src"))

    def rank(points: DataFrame, marks: DataFrame, name: str) -> DataFrame:
        both = _celled(points.unionByName(marks), "k")
        return running(both, keys, ["k", "src"], F.sum, F.col(index).isNull().cast("long"), name).where(F.col(index).isNotNull()).select(*keys, index, name)

    left = rank(ended, start, "left")
    right = rank(began, end, "right")
    return containers.join(left, [*keys, index]).join(right, [*keys, index])


def neighbour_distances(things: DataFrame, intervals: DataFrame, keys: Keys | None = None, row_id: str = "row_id") -> DataFrame:
    """``things`` with ``to_prev`` (start minus the last end up to it) and ``to_next`` (first start from its end on, minus the end); -1 if there is none."""
    keys = keys or ["run_id"]
    null = F.lit(None).cast("long")

    def look(points: Column, marks: Column, name: str) -> DataFrame:
        """For each thing the greatest of the intervals' ``points`` up to its ``marks``."""
        every = intervals.select(*keys, F.lit(None).cast(things.schema[row_id].dataType).alias(row_id), points.alias("k"), points.alias("v"), F.lit(0).alias("src"))
        both = _celled(every.unionByName(things.select(*keys, row_id, marks.alias("k"), null.alias("v"), F.lit(1).alias("src"))), "k")
        return running(both, keys, ["k", "src"], F.max, F.col("v"), name).where(F.col(row_id).isNotNull()).select(*keys, row_id, name)

    before = look(F.col("endtime"), F.col("time"), "__before")
    after = look(-F.col("time"), -F.col("endtime"), "__after").withColumn("__after", -F.col("__after"))
    out = things.join(before, [*keys, row_id]).join(after, [*keys, row_id])
    return out.withColumn("to_prev", F.coalesce(F.col("time") - F.col("__before"), F.lit(-1))).withColumn("to_next", F.coalesce(F.col("__after") - F.col("endtime"), F.lit(-1))).drop("__before", "__after")


def replace_merged(rows: DataFrame, merged: DataFrame, width: int, keys: Keys | None = None) -> DataFrame:
    """``rows`` without those that touch a row of ``merged``, and ``merged``."""
    return overlap_pairs(rows, merged, width, 0, keys, "left_anti").unionByName(merged)


def record_links(records: DataFrame, samples: int, row_id: str = "row_id") -> DataFrame:
    """``previous`` and ``next``: the fragments of the same pulse before and after each record, else -1."""
    order = Window.partitionBy("run_id", "channel").orderBy("time")
    follows = (F.col("record_i") != 0) & (F.col("time") == F.lag("time").over(order) + samples * F.lag("dt").over(order))
    linked = records.withColumn("previous", F.when(follows, F.lag(row_id).over(order)).otherwise(F.lit(-1)))
    return linked.withColumn("next", F.when(F.lead("previous").over(order) == F.col(row_id), F.lead(row_id).over(order)).otherwise(F.lit(-1)))


def joined_hits(hits: DataFrame, before: int, after: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """Per channel, hits extended by ``before`` and ``after`` ns, cut to [start, end), and joined where one ends at or after the next starts; the end is that of the last."""
    low, high = F.col("time") - before, F.col("endtime") + after
    rows = hits.withColumn("time", F.greatest(low, F.lit(start)) if start is not None else low).withColumn("endtime", F.least(high, F.lit(end)) if end is not None else high)
    order = Window.partitionBy("run_id", "channel").orderBy("time", "endtime")
    new = F.coalesce((F.lag("endtime").over(order) < F.col("time")).cast("int"), F.lit(1))
    rows = rows.withColumn("__new", new).withColumn("__group", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("run_id", "channel", "__group").agg(F.min("time").alias("time"), F.max_by("endtime", F.struct("time", "endtime")).alias("endtime"), F.count(F.lit(1)).alias("n")).drop("__group")


def time_gaps(df: DataFrame, keys: Keys | None = None) -> DataFrame:
    """``gap``: start minus the greatest end before; null for the first row."""
    rows = running(_celled(df), keys or ["run_id"], ["time", "endtime"], F.max, F.col("endtime"), "gap", before=True)
    return rows.withColumn("gap", F.col("time") - F.col("gap")).drop("__cell")


def first_break(df: DataFrame, safe: int, keys: Keys | None = None) -> DataFrame:
    """``right``: whether the row is at or behind the first start that is ``safe`` or more after all ends before; null in runs without one."""
    keys = keys or ["run_id"]
    marked = time_gaps(df, keys)
    first = marked.where(F.col("gap") >= safe).groupBy(*keys).agg(F.min("time").alias("__first")).select("__first", *[F.col(k).alias(f"__f_{k}") for k in keys])
    return marked.join(first, _same(keys, "__f_"), "left").withColumn("right", F.col("time") >= F.col("__first")).drop("gap", "__first", *[f"__f_{k}" for k in keys])


def continuity_breaks(chunks: DataFrame, keys: Keys | None = None) -> DataFrame:
    """Rows of ``chunks`` (time, endtime) that don't begin where the one before ends, with ``expected``: that end."""
    order = _order(keys or ["run_id"], "time", "endtime")
    return chunks.withColumn("expected", F.lag("endtime").over(order)).where("expected != time")


def sort_by_time(df: DataFrame, ties: Keys | None = None) -> DataFrame:
    """``df`` by time, channel (where there is one) and ``ties``: a global sort by ranges, stable if the ties are told apart."""
    return df.orderBy("time", *(["channel"] if "channel" in df.columns else []), *(ties or []))


def split_at(df: DataFrame, t: int, early: bool = False, keys: Keys | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that end up to a cut, and rows that start from it on.

    The cut is ``t``; where rows straddle it, the latest place before that no
    row straddles if ``early``, else it is an error when the result is read.
    """
    keys = keys or ["run_id"]
    whole = Window.partitionBy(*keys)
    straddles = (F.col("time") < t) & (F.col("endtime") > t)
    if not early:
        ok = F.when(straddles, F.raise_error(F.lit(f"a row straddles {t}"))).otherwise(F.lit(True))
        return df.where(ok & (F.col("endtime") <= t)), df.where(ok & (F.col("time") >= t))
    before = F.max("endtime").over(_order(keys, "time", "endtime").rowsBetween(Window.unboundedPreceding, -1))
    place = F.when((F.col("time") <= t) & (F.coalesce(before, F.col("time")) <= F.col("time")), F.col("time"))
    cut = F.when(F.max(straddles.cast("int")).over(whole) == 0, F.lit(t)).otherwise(F.max("__place").over(whole))
    marked = df.withColumn("__place", place).withColumn("__cut", cut)
    return marked.where("endtime <= __cut").drop("__place", "__cut"), marked.where("time >= __cut").drop("__place", "__cut")


def neighbours(df: DataFrame, window: int, keys: Keys | None = None, column: str = "endtime") -> DataFrame:
    """``neighbours``: rows whose ``column`` differs by less than ``window``, itself included.

    The number of rows up to the upper end minus that of rows below the lower
    one; both are two-level running counts over the different values.
    """
    keys = keys or ["run_id"]
    values = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    marks = lambda shift, src: values.select(*keys, (F.col("k") + shift).alias("k"), F.lit(0).cast("long").alias("n"), F.lit(src).alias("src"), F.col("k").alias("of"))
    points = values.select(*keys, "k", "n", F.lit(1).alias("src"), F.lit(None).cast("long").alias("of"))
    ranked = running(_celled(points.unionByName(marks(1 - window, 0)).unionByName(marks(window - 1, 2)), "k"), keys, ["k", "src"], F.sum, F.col("n"), "rank")
    counts = ranked.where("of IS NOT NULL").groupBy(*keys, "of").agg((F.max("rank") - F.min("rank")).alias("neighbours"))
    counts = counts.select(*[F.col(k).alias(f"__n_{k}") for k in keys], F.col("of").alias(f"__n_{column}"), "neighbours")
    return df.join(counts, _same([*keys, column], "__n_"), "left").drop(*[f"__n_{c}" for c in [*keys, column]])


def positional_merge(frames: list[DataFrame], keys: Keys | None = None) -> DataFrame:
    """Frames of one kind side by side by (run, row): a name's place is that of its first frame, its value that of the last.

    Null keys equal each other.  A row that a frame lacks is an error when the
    result is read.
    """
    keys = keys or ["run_id", "row_id"]
    out, names = None, []
    for k, frame in enumerate(frames):
        names += [c for c in frame.columns if c not in names]
        own = frame.select(*[F.col(c).alias(f"__k_{c}") for c in keys], *[F.col(c).alias(f"__{k}_{c}") for c in frame.columns if c not in keys], F.lit(1).alias(f"__{k}"))
        if out is None:
            out = own.withColumnsRenamed({f"__k_{c}": c for c in keys})
        else:
            out = out.join(own, _same(keys, "__k_"), "full").withColumns({c: F.coalesce(c, f"__k_{c}") for c in keys}).drop(*[f"__k_{c}" for c in keys])
    whole = F.lit(True)
    for k in range(len(frames)):
        whole &= F.col(f"__{k}").isNotNull()
    last = {c: k for k, frame in enumerate(frames) for c in frame.columns}
    checked = out.where(F.when(whole, True).otherwise(F.raise_error(F.lit("rows of one frame are missing in another"))))
    return checked.select(*[F.col(c) if c in keys else F.col(f"__{last[c]}_{c}").alias(c) for c in names])


def accumulate(df: DataFrame, fields: list[str], others: list[str] | None = None, keys: Keys | None = None) -> DataFrame:
    """Sums of ``fields``, of ``others`` the first value by time, and start, end and n_rows, a row for each run."""
    sums = [F.sum(c).alias(c) for c in fields]
    first = [F.min_by(c, "time").alias(c) for c in others or []]
    return df.groupBy(*(keys or ["run_id"])).agg(*sums, *first, F.min("time").alias("start"), F.max("endtime").alias("end"), F.count(F.lit(1)).alias("n_rows"))


def all_of(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``name``: whether all the columns hold."""
    both = F.lit(True)
    for c in columns:
        both &= F.col(c)
    return df.withColumn(name, both)


def loop(base: DataFrame, things: DataFrame, index: str, width: int, compute: Callable[[Column], dict[str, Column]], fields: list[str], window: int | None = None, keys: Keys | None = None) -> DataFrame:
    """Per row of ``base`` the expressions that ``compute`` makes of the array of things it holds (or touches, with ``window``), by time."""
    keys = keys or ["run_id"]
    pairs = overlap_pairs(things, base.select(*keys, index, "time", "endtime"), width, window or 0, keys)
    if window is None:
        pairs = pairs.where("b_time <= a_time AND a_endtime <= b_endtime")
    lists = pairs.groupBy(*[F.col(f"b_{k}").alias(k) for k in keys], F.col(f"b_{index}").alias(index)).agg(F.array_sort(F.collect_list(F.struct(*[F.col(f"a_{c}").alias(c) for c in ["time", *fields]]))).alias("__things"))
    kind = lists.schema["__things"].dataType
    rows = base.join(lists, [*keys, index], "left").withColumn("__things", F.coalesce("__things", F.from_json(F.lit("[]"), kind)))
    return rows.withColumns(compute(F.col("__things"))).drop("__things")
