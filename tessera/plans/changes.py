"""Changes of a relation, as the relation that they lead to.

Tables are files that are never altered in place: a change is a plan over the
old rows, to be saved beside them. Keys are not enforced here; see
:func:`tessera.sources.key_violations` and :func:`tessera.sources.violations`.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .relation import Relation, _column


def insert(target: Relation, rows: Relation) -> Relation:
    """The target with new rows; columns that the rows lack get their default,
    or nil. A row that is there already stays one row."""
    new = rows.df.withColumns({c: F.lit(v) for c, v in target.defaults.items() if c not in rows.columns})
    both = target.df.unionByName(new, allowMissingColumns=True).select(target.columns)
    return replace(target, df=both.distinct(), keys=target.keys or frozenset([frozenset(target.columns)]))


def delete(target: Relation, condition: Column | str) -> Relation:
    """Without the rows for which the condition is true; nil keeps a row."""
    return Relation(target.df.where(~F.coalesce(_column(condition), F.lit(False))), target.keys)


def update(target: Relation, condition: Column | str, **made: Column | str) -> Relation:
    """New values where the condition is true, all from the old row. The keys
    stay, so the caller vouches for changes of key columns."""
    met = F.coalesce(_column(condition), F.lit(False))
    kinds = dict(target.df.dtypes)
    new = {c: F.when(met, _column(e)).otherwise(F.col(c)).cast(kinds[c]) for c, e in made.items()}
    return Relation(target.df.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in target.columns)), target.keys)


def delete_referring(child: Relation, gone: Relation, by: Mapping[str, str]) -> Relation:
    """Cascade: the child without rows whose reference meets a deleted row."""
    return child.without(gone, by)


def clear_referring(child: Relation, gone: Relation, by: Mapping[str, str], **made: Column | str) -> Relation:
    """Clear or set: references that meet a deleted row become nil, or `made`."""
    hit = gone.df.select(*(F.col(b).alias(f"__{b}") for b in by.values())).distinct().withColumn("__gone", F.lit(True))
    met = child.df.join(hit, [child.df[a] == hit[f"__{b}"] for a, b in by.items()], "left")
    kinds = dict(child.df.dtypes)
    new = {a: F.when(F.col("__gone"), _column(made.get(a, F.lit(None)))).otherwise(F.col(a)).cast(kinds[a]) for a in by}
    return Relation(met.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in child.columns)), child.keys)
