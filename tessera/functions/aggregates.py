"""Aggregates: nil is skipped; an empty set gives nil except where noted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECIMAL = "decimal(28,10)"


def count(c: str | None = None, distinct: bool = False) -> Column:
    """Rows, or rows where the column isn't nil; 0 on empty."""
    made = F.count_distinct(F.col(c)) if c and distinct else F.count(F.col(c) if c else F.lit(1))
    return made.cast("int")


def total(c: str, distinct: bool = False) -> Callable[[DataFrame], Column]:
    """The sum in its input's type, so what doesn't fit it is an error. For
    :meth:`Relation.group`, which gives the frame."""
    return lambda df: (F.sum_distinct if distinct else F.sum)(F.col(c)).cast(df.schema[c].dataType)


def least(c: str) -> Column:
    return F.min(F.col(c))


def greatest(c: str) -> Column:
    return F.max(F.col(c))


def _by_lower(c: str) -> Column:
    """Nil stays nil, so it is skipped."""
    return F.when(F.col(c).isNotNull(), F.struct(F.lower(F.col(c)).alias("k"), F.col(c).alias("v")))


def least_text(c: str) -> Column:
    """Case is ignored; among equals the least by code point is returned."""
    return F.min(_by_lower(c))["v"]


def greatest_text(c: str) -> Column:
    return F.max(_by_lower(c))["v"]


def average(c: str) -> Column:
    """Exact decimal mean."""
    return F.avg(F.col(c).cast(DECIMAL)).cast(DECIMAL)


def average_span(c: str) -> Column:
    """The mean of time spans."""
    return F.avg(F.col(c))


def every(c: str) -> Column:
    """True on empty."""
    return F.coalesce(F.every(F.col(c)), F.lit(True))


def some(c: str) -> Column:
    """False on empty."""
    return F.coalesce(F.some(F.col(c)), F.lit(False))


def concat(c: str, delimiter: str = "", order: str | None = None, distinct: bool = False, delimiter_column: str | None = None) -> Column:
    """Joined in the order of a column, by default its own; nil is skipped.
    Distinct texts are in their own order. A column of delimiters gives each
    text the one that stands before it."""
    quoted = lambda name: f"`{name}`"
    if distinct:
        return F.expr(f"listagg(distinct {quoted(c)}, {_literal(delimiter)}) within group (order by {quoted(c)})")
    at = quoted(order or c)
    if delimiter_column is None:
        return F.expr(f"listagg({quoted(c)}, {_literal(delimiter)}) within group (order by {at}, {quoted(c)})")
    led = f"{quoted(delimiter_column)} || {quoted(c)}"
    joined = F.expr(f"listagg({led}, '') within group (order by {at}, {quoted(c)})")
    return F.substring(joined, F.length(F.min_by(F.col(delimiter_column), F.struct(F.col(order or c), F.col(c)))) + 1, F.length(joined))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def to_list(c: str, order: str | None = None) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(order or c).alias("k"), F.col(c).alias("v")))), lambda p: p["v"])


def custom(c: str, start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Column:
    """A user's aggregate as initial value, step and result over the ordered
    list, for steps that depend on the order; see also Relation.aggregate."""
    return F.aggregate(F.sort_array(F.collect_list(F.col(c))), start, step, finish)
