"""Rows as values: the operators of a relation on one row, a struct column.

A struct tells its fields to Spark only, so operators that need them take the
names.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def row(**made: Column | object) -> Column:
    return F.struct(*((e if isinstance(e, Column) else F.lit(e)).alias(n) for n, e in made.items()))


def list_of(*values: Column | object) -> Column:
    return F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values))


def add(r: Column, **made: Column) -> Column:
    return reduce(lambda x, n: x.withField(n, made[n]), made, r)


redefine = add


def over(r: Column, *names: str) -> Column:
    """A nil row stays nil."""
    return F.when(r.isNotNull(), F.struct(*(r[n].alias(n) for n in names)))


def remove(r: Column, *names: str) -> Column:
    return r.dropFields(*names)


def rename(r: Column, names: Iterable[str], to: Mapping[str, str] | str) -> Column:
    """By a mapping, or a prefix for every field."""
    new = {n: f"{to}.{n}" for n in names} if isinstance(to, str) else {n: to.get(n, n) for n in names}
    return F.when(r.isNotNull(), F.struct(*(r[n].alias(new[n]) for n in names)))


def join(a: Column, a_names: Iterable[str], b: Column, b_names: Iterable[str]) -> Column:
    """Natural: fields of both, nil where a common field differs or is nil."""
    a_names, b_names = list(a_names), list(b_names)
    common = [n for n in a_names if n in b_names]
    made = F.struct(*(a[n].alias(n) for n in a_names), *(b[n].alias(n) for n in b_names if n not in common))
    return F.when(reduce(lambda x, n: x & (a[n] == b[n]), common, a.isNotNull() & b.isNotNull()), made)


def equals(a: Column, b: Column) -> Column:
    """Nil equals nil within rows."""
    return a.eqNullSafe(b)
