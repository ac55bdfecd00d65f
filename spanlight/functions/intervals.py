"""Column expressions on half-open intervals [time, endtime) in integer nanoseconds."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_endtime(df: DataFrame) -> DataFrame:
    """``endtime`` as stored, else time + length * dt in 64 bits."""
    if "endtime" in df.columns:
        return df
    return df.withColumn("endtime", F.col("time") + F.col("length").cast("long") * F.col("dt"))


def overlap_range(a1: Column, n_a: Column, b1: Column, n_b: Column) -> Column:
    """Struct of (a_start, a_end, b_start, b_end): where [a1, a1+n_a) and [b1, b1+n_b) overlap, in the frame of each; zeros if nowhere."""
    start, end = F.greatest(a1, b1), F.least(a1 + n_a, b1 + n_b)
    some = end > start
    part = lambda x: F.when(some, x).otherwise(F.lit(0)).cast("long")
    return F.struct(part(start - a1).alias("a_start"), part(end - a1).alias("a_end"), part(start - b1).alias("b_start"), part(end - b1).alias("b_end"))


def fill_defaults(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls become -1 in integer columns and NaN in the others that are numeric."""
    out = df
    for field in df.schema.fields:
        if columns is not None and field.name not in columns:
            continue
        if isinstance(field.dataType, T.IntegralType):
            out = out.withColumn(field.name, F.coalesce(F.col(field.name), F.lit(-1).cast(field.dataType)))
        elif isinstance(field.dataType, T.FractionalType):
            out = out.withColumn(field.name, F.coalesce(F.col(field.name), F.lit(float("nan")).cast(field.dataType)))
    return out


def floor_divide(a: Column, b: Column) -> Column:
    """Integer division towards minus infinity."""
    return ((a - F.pmod(a, b)) / b).cast("long")


_COMPARE = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "=", ast.NotEq: "!="}
_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%"}


def _sql(node: ast.AST) -> str:
    if isinstance(node, ast.Expression):
        return _sql(node.body)
    if isinstance(node, ast.BinOp):
        a, b = _sql(node.left), _sql(node.right)
        if isinstance(node.op, ast.BitAnd):
            return f"({a} AND {b})"
        if isinstance(node.op, ast.BitOr):
            return f"({a} OR {b})"
        if isinstance(node.op, ast.Pow):
            return f"power({a}, {b})"
        if type(node.op) in _BINARY:
            return f"({a} {_BINARY[type(node.op)]} {b})"
    if isinstance(node, ast.BoolOp):
        return "(" + (" AND " if isinstance(node.op, ast.And) else " OR ").join(map(_sql, node.values)) + ")"
    if isinstance(node, ast.UnaryOp):
        sign = {ast.Invert: "NOT ", ast.Not: "NOT ", ast.USub: "-", ast.UAdd: ""}[type(node.op)]
        return f"({sign}{_sql(node.operand)})"
    if isinstance(node, ast.Compare):
        # NaN passes no comparison but !=
        parts, left = [], node.left
        for op, right in zip(node.ops, node.comparators, strict=True):
            parts.append(f"({_sql(left)} {_COMPARE[type(op)]} {_sql(right)})")
            left = right
        return "(" + " AND ".join(parts) + ")"
    if isinstance(node, ast.Name):
        return f"`{node.id}`"
    if isinstance(node, ast.Constant):
        return "'" + node.value.replace("'", "''") + "'" if isinstance(node.value, str) else str(node.value).lower() if isinstance(node.value, bool) else repr(node.value)
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        return f"{node.func.id}({', '.join(map(_sql, node.args))})"
    raise ValueError(f"{ast.unparse(node)} is no part of a selection")


def predicate(selection: str | list[str] | tuple[str, ...]) -> Column:
    """A row predicate in Python's syntax, with & | ~ and ** ; several are joined by AND."""
    many = [selection] if isinstance(selection, str) else list(selection)
    return F.expr(" AND ".join(_sql(ast.parse(f"({s})", mode="eval")) for s in many))
