"""Operators that a user makes: of scalars, of tables, and by operand types.

Bodies are SQL expressions that Catalyst takes into the plan, so nothing runs
row by row in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.relation import PATHS, Relation


def scalar_operator(spark: SparkSession, name: str, operands: str, returns: str, body: str) -> Callable[..., Column]:
    """A temporary function, for SQL and as a builder of columns."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({operands}) RETURNS {returns} RETURN {body}")
    return lambda *args: F.call_function(name, *(a if isinstance(a, Column) else F.lit(a) for a in args))


def table_operator(spark: SparkSession, name: str, operands: str, heading: str, body: str, *keys: tuple[str, ...]) -> Callable[..., Relation]:
    """A temporary table function; the result of a call is a relation."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({operands}) RETURNS TABLE({heading}) RETURN {body}")
    return lambda *args: Relation.of(spark.sql(f"SELECT * FROM {name}({', '.join(f':a{k}' for k in range(len(args)))})", {f"a{k}": v for k, v in enumerate(args)}), *keys)


class Overloads:
    """Operators of one name, told apart by the types of their operands.

    The operator of just these types is taken, else the only one, or the
    nearest, that all operands can be converted to.
    """

    def __init__(self, name: str):
        self.name, self.known = name, {}

    def add(self, *types: str):
        def put(f: Callable[..., Column]):
            if types in self.known:
                raise ValueError(f"{self.name}{types} is there already")
            self.known[types] = f
            return f

        return put

    def resolve(self, types: tuple[str, ...]) -> tuple[str, ...]:
        if types in self.known:
            return types
        steps = {}
        for own in self.known:
            if len(own) == len(types):
                way = [next((p.index(b) - p.index(a) for p in PATHS if a in p and b in p and p.index(b) >= p.index(a)), None) if a != b else 0
                       for a, b in zip(types, own, strict=True)]
                if None not in way:
                    steps[own] = sum(way)
        nearest = [own for own, n in steps.items() if n == min(steps.values())]
        if len(nearest) != 1:
            raise TypeError(f"{'no' if not nearest else 'more than one'} operator {self.name}{types}")
        return nearest[0]

    def __call__(self, df: DataFrame, *columns: str) -> Column:
        own = dict(df.dtypes)
        types = tuple(own[c] for c in columns)
        found = self.resolve(types)
        return self.known[found](*(F.col(c).cast(kind) for c, kind in zip(columns, found, strict=True)))
