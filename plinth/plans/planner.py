"""Lowers syntax trees to DataFrame plans: binding of literals to column types, predicates, order, projection, limit."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fulltext, spatial, vectors
from . import dialect as d

_OPS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def literal(value: Any, kind: T.DataType) -> Column | None:
    """value as a column's type, or None if it has no such value; never a run-time cast error.

    Constants are bound here, not cast in the plan, so that comparisons reach the Parquet scan."""
    if value is None:
        return F.lit(None)
    if isinstance(kind, T.NumericType):
        try:
            number = float(value) if not isinstance(value, (int, float)) else value
            whole = float(number).is_integer()
        except (TypeError, ValueError, OverflowError):
            return None
        if isinstance(kind, T.IntegralType) and whole and -(2**63) <= number < 2**63:
            return F.lit(int(number))
        return F.lit(float(number))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        import datetime

        try:
            moment = datetime.datetime.fromisoformat(str(value))
        except ValueError:
            return None
        return F.lit(str(moment.date())).cast("date") if isinstance(kind, T.DateType) else F.lit(str(moment)).cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit(value) if isinstance(value, str) else None
    return F.lit(value) if not isinstance(value, tuple) else None


def comparison(df: DataFrame, name: str, op: str, value: Any) -> Column:
    """A comparison; with a value that the column's type cannot hold, only != is true."""
    if name not in df.columns:
        return F.lit(False)
    bound = literal(value, df.schema[name].dataType)
    if bound is None:
        return F.col(name).isNotNull() if op == "!=" else F.lit(False)
    return _OPS[op](F.col(name), bound)


def predicate(df: DataFrame, where: Any, points: dict[str, tuple[str, str]] | None = None) -> Column:
    """A condition without ranked parts as one boolean column."""
    if isinstance(where, d.Both):
        return predicate(df, where.left, points) & predicate(df, where.right, points)
    if isinstance(where, d.Either):
        return predicate(df, where.left, points) | predicate(df, where.right, points)
    if isinstance(where, d.Compare):
        return comparison(df, where.field, where.op, where.value)
    if isinstance(where, d.Between):
        return comparison(df, where.field, ">=", where.low) & comparison(df, where.field, "<=", where.high)
    if isinstance(where, d.Near) and isinstance(where.reach, float):
        x, y = axes(df, where.field, points)
        return spatial.within(x, y, where.x, where.y, where.reach)
    raise d.DialectError(f"{type(where).__name__} ranks rows and stands alone or beside AND conditions")


def axes(df: DataFrame, name: str, points: dict[str, tuple[str, str]] | None = None) -> tuple[Column, Column]:
    """The x and y of a spatial field: declared columns, or the first two elements of an array."""
    if points and name in points:
        return F.col(points[name][0]), F.col(points[name][1])
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.get(name, F.lit(0)).cast("double"), F.get(name, F.lit(1)).cast("double")
    raise d.DialectError(f"{name} is not a point")


def _split(where: Any) -> tuple[list[Any], Any]:
    """The ranked parts of a conjunction and what is left of it."""
    if isinstance(where, (d.Match, d.Similar)) or isinstance(where, d.Near) and isinstance(where.reach, int):
        return [where], None
    if isinstance(where, d.Both):
        (a, x), (b, y) = _split(where.left), _split(where.right)
        return a + b, x if y is None else y if x is None else d.Both(x, y)
    return [], where


def select(df: DataFrame, query: d.Select, key: str, strict: bool = False, points: dict[str, tuple[str, str]] | None = None, vector_of=None, index_of=None) -> DataFrame:
    """WHERE, ORDER BY (also by columns not selected), LIMIT, projection.

    Unknown columns of the select list are dropped, or with `strict` an error.  Ranked conditions add `score` or
    `distance`; they see the rows that the other conditions leave (text statistics are those of all rows), and without
    ORDER BY their order is the result's."""
    ranked, rest = _split(query.where)
    if len(ranked) > 1:
        raise d.DialectError("one ranked condition at a time")
    whole = df
    if rest is not None:
        df = df.where(predicate(df, rest, points))
    natural: list[Column] = []
    for r in ranked:
        if isinstance(r, d.Match):
            index = index_of(r.field) if index_of else None
            df = fulltext.matching_rows(whole, key, r.field, r.text, 100 if query.limit is None else query.limit, index, df, "_pos")
            natural = [F.desc("score"), F.asc(key)]
        elif isinstance(r, d.Near):
            x, y = axes(df, r.field, points)
            df = spatial.nearest(df, x, y, r.x, r.y, r.reach, key)
            natural = [F.asc("distance"), F.asc(key)]
        else:
            target = r.target if not isinstance(r.target, str) or vector_of is None else vector_of(r.target)
            df = vectors.cosine_top(df, r.field, list(target), 10 if query.limit is None else query.limit, key)
            natural = [F.desc("score"), F.asc(key)]
    if query.order and query.order[0] in df.columns:
        name, descending = query.order
        df = df.orderBy(F.desc(name) if descending else F.asc(name), *([F.asc(key)] if key != name and key in df.columns else []))
    elif natural:
        df = df.orderBy(*natural)
    if query.limit is not None:
        df = df.limit(query.limit)
    if query.columns is None:
        return df
    unknown = [c for c in query.columns if c not in df.columns]
    if unknown and strict:
        raise d.DialectError(f"no column is called {', '.join(unknown)}")
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(query.columns) if c in df.columns])
