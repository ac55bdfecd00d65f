"""The query surface: time, then rows, then columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import predicate

SECOND = 1_000_000_000


def time_filter(df: DataFrame, time_range: tuple[int, int], how: str = "fully_contained") -> DataFrame:
    """``fully_contained``, ``touching`` or ``skip``."""
    t0, t1 = time_range
    if how == "skip":
        return df
    if how == "fully_contained":
        return df.where((F.col("time") >= t0) & (F.col("endtime") <= t1))
    if how == "touching":
        return df.where((F.col("endtime") > t0) & (F.col("time") < t1))
    raise ValueError(f"no time selection {how}")


def apply_selection(df: DataFrame, selection: str | list[str] | Callable[[DataFrame], Column] | None = None, keep_columns: list[str] | None = None, drop_columns: list[str] | None = None, time_range: tuple[int, int] | None = None, time_selection: str = "fully_contained") -> DataFrame:
    """Kept columns stay in the schema's order; keeping and dropping at once is an error."""
    if keep_columns is not None and drop_columns is not None:
        raise ValueError("either keep or drop columns")
    if time_range is not None:
        df = time_filter(df, time_range, time_selection)
    if selection is not None:
        df = df.where(selection(df) if callable(selection) else predicate(selection))
    if keep_columns is not None:
        if missing := set(keep_columns) - set(df.columns):
            raise ValueError(f"no columns {sorted(missing)}")
        return df.select(*[c for c in df.columns if c in keep_columns])
    return df.drop(*drop_columns) if drop_columns else df


def absolute_range(run_start: int, time_range: tuple[int, int] | None = None, seconds_range: tuple[float, float] | None = None, time_within: tuple[int, int] | None = None) -> tuple[int, int] | None:
    """One of the three ways to give a range, in ns; seconds count from the run's start, floored to a second."""
    given = [x for x in (time_range, seconds_range, time_within) if x is not None]
    if len(given) > 1:
        raise ValueError("one kind of range at most")
    if seconds_range is not None:
        base = run_start // SECOND * SECOND
        return base + int(seconds_range[0] * SECOND), base + int(seconds_range[1] * SECOND)
    return given[0] if given else None


def copy_fields(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns that ``like`` has too, in its order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in like.schema.fields if f.name in df.columns])
