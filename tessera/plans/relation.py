"""Relations: a DataFrame, the keys known to hold, and an order.

Operators are those of a set-based algebra. Spark's frames are bags, so a
relation carries its keys and removes duplicates exactly where the algebra
needs it: a projection that keeps a key is a plain select, one that loses every
key is a select and a distinct. All work is declared to Catalyst.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import durable, numbered

Key = frozenset
Expression = "Column | str"


def _column(e: Column | str) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def _least(keys: Iterable[Key]) -> frozenset[Key]:
    """Drop keys that contain another key."""
    keys = set(keys)
    return frozenset(k for k in keys if not any(o < k for o in keys))


#: Kinds of numbers and of times, each convertible to those behind it.
PATHS = (("smallint", "int", "bigint", "decimal(28,8)", "decimal(28,10)", "double"), ("date", "timestamp_ntz", "timestamp"))


def common_type(a: str, b: str) -> str:
    """The type that columns of two sets meet in; without a way from one to the other an error."""
    if a == b:
        return a
    for path in PATHS:
        if a in path and b in path:
            return max(a, b, key=path.index)
    raise ValueError(f"no conversion between {a} and {b}")


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    keys: frozenset[Key] = field(default_factory=frozenset)
    ordering: tuple[tuple[str, bool], ...] = ()
    #: Values of columns that an insert leaves out, and named conditions on each row.
    defaults: Mapping[str, object] = field(default_factory=dict)
    constraints: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, *keys: Iterable[str]) -> Relation:
        """With declared keys the rows are taken as a set already; without, duplicates go."""
        if not keys:
            return cls(df.distinct(), frozenset([Key(df.columns)]))
        return cls(df, _least(Key(k) for k in keys))

    @classmethod
    def bag(cls, df: DataFrame) -> Relation:
        """Rows of a source without a key, as they are. No key is known, so every
        operator but restriction, extension, renaming and grouping makes a set."""
        return cls(df)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def _made(self, df: DataFrame, keys: Iterable[Key]) -> Relation:
        """Remove duplicates if no key is left; then all columns are one."""
        keys = _least(keys)
        if keys:
            return Relation(df, keys)
        return Relation(df.distinct(), frozenset([Key(df.columns)]))

    # Shaping

    def where(self, condition: Column | str | None = None, equal: Iterable[str] = (), **values: object) -> Relation:
        """Rows for which the condition is true; nil counts as false. Columns
        held equal to one value (given as name=value, or named by `equal` where
        the condition says so) leave the keys."""
        met = self.df if condition is None else self.df.where(condition)
        for name, value in values.items():
            met = met.where(F.col(f"`{name}`") == F.lit(value))
        return replace(self, df=met, keys=_least(k - Key(equal) - Key(values) for k in self.keys))

    def over(self, *names: str) -> Relation:
        return self._made(self.df.select(*(F.col(f"`{c}`") for c in names)), [k for k in self.keys if k <= set(names)])

    def remove(self, *names: str) -> Relation:
        return self.over(*[c for c in self.columns if c not in names])

    def add(self, **made: Column | str) -> Relation:
        """New columns, each from the input's columns only. A plain copy of a
        column can stand for it in the keys."""
        clash = set(made) & set(self.columns)
        if clash:
            raise ValueError(f"columns exist: {sorted(clash)}")
        copies = [(e, n) for n, e in made.items() if isinstance(e, str) and e in self.columns]
        keys = [k - {old} | {new} for k in self.keys for old, new in copies if old in k]
        return replace(self, df=self.df.select("*", *(_column(e).alias(n) for n, e in made.items())), keys=frozenset([*self.keys, *keys]))

    def specify(self, **made: Column | str) -> Relation:
        """Project, rename and extend at once: name = column name or expression."""
        source = {n: e for n, e in made.items() if isinstance(e, str) and e in self.columns}
        back = {e: n for n, e in source.items()}
        keys = [Key(back[c] for c in k) for k in self.keys if k <= set(back)]
        return self._made(self.df.select(*(_column(e).alias(n) for n, e in made.items())), keys)

    def rename(self, names: Mapping[str, str] | str) -> Relation:
        """By a mapping, or a prefix for every column."""
        to = {c: f"{names}.{c}" for c in self.columns} if isinstance(names, str) else dict(names)
        new = lambda c: to.get(c, c)
        return Relation(self.df.toDF(*map(new, self.columns)), frozenset(Key(map(new, k)) for k in self.keys),
                        tuple((new(c), up) for c, up in self.ordering))

    def redefine(self, **made: Column | str) -> Relation:
        """Replace columns; keys and orders on them go."""
        df = self.df.select(*(_column(made[c]).alias(c) if c in made else F.col(f"`{c}`") for c in self.columns))
        kept = [k for k in self.keys if not k & set(made)]
        return self._made(df, kept)

    def adorn(self, *keys: Iterable[str], order: tuple[tuple[str, bool], ...] = (), metadata: Mapping[str, dict] | None = None,
              defaults: Mapping[str, object] | None = None, constraints: Mapping[str, str] | None = None) -> Relation:
        """Attach keys, an order, metadata, defaults or constraints. The rows
        stay as they are: nothing is enforced here."""
        df = self.df
        for name, tags in (metadata or {}).items():
            df = df.withMetadata(name, tags)
        return Relation(df, _least([*self.keys, *(Key(k) for k in keys)]), order or self.ordering,
                        {**self.defaults, **(defaults or {})}, {**self.constraints, **(constraints or {})})

    def violations(self, name: str = "constraint") -> DataFrame:
        """The rows for which a constraint is false, once for each, with its
        name; nil satisfies it. One pass over the rows."""
        broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(c), F.lit(True)), F.lit(n)) for n, c in self.constraints.items())))
        return self.df.select("*", F.explode(broken).alias(name)) if self.constraints else self.df.limit(0).withColumn(name, F.lit(""))

    # Joins

    def _common(self, other: Relation) -> list[str]:
        return [c for c in self.columns if c in other.columns]

    def _join_keys(self, other: Relation, left_on: Iterable[str], right_on: Iterable[str], how: str) -> list[Key]:
        """Which side's rows meet at most one of the other's decides. The side
        that an outer join fills with nil has no key alone: many rows are nil in it."""
        if how == "full":
            return []
        one_right = any(k <= set(right_on) for k in other.keys) and how != "right"
        one_left = any(k <= set(left_on) for k in self.keys) and how != "left"
        if one_left and one_right:
            return [*self.keys, *other.keys]
        if one_right:
            return [*self.keys]
        if one_left:
            return [*other.keys]
        return [a | b for a in self.keys for b in other.keys]

    def join(self, other: Relation, by: Mapping[str, str] | None = None, how: str = "inner", row_exists: str | None = None) -> Relation:
        """Natural join, or by pairs of columns of different names; nil meets
        nothing. how: inner, left, right or, as an extension, full, where no key
        is known to hold. row_exists names a flag column."""
        on = dict(by) if by else {c: c for c in self._common(other)}
        if by and self._common(other):
            raise ValueError(f"both sides have {self._common(other)}")
        left, right = self.df, other.df
        if row_exists:
            if how == "right":
                left = left.withColumn(row_exists, F.lit(True))
            else:
                right = right.withColumn(row_exists, F.lit(True))
        if not on:
            df = left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
        elif by:
            df = left.join(right, [left[a] == right[b] for a, b in on.items()], how)
        else:
            df = left.join(right, list(on), how)
        if row_exists:
            df = df.withColumn(row_exists, F.coalesce(row_exists, F.lit(False)))
        return self._made(df, self._join_keys(other, on, on.values(), how))

    def left_join(self, other: Relation, by: Mapping[str, str] | None = None, row_exists: str | None = None) -> Relation:
        return self.join(other, by, "left", row_exists)

    def full_join(self, other: Relation, by: Mapping[str, str] | None = None) -> Relation:
        return self.join(other, by, "full")

    def right_join(self, other: Relation, by: Mapping[str, str] | None = None, row_exists: str | None = None) -> Relation:
        return self.join(other, by, "right", row_exists)

    lookup = join
    left_lookup, right_lookup = left_join, right_join

    def times(self, other: Relation) -> Relation:
        if self._common(other):
            raise ValueError(f"both sides have {self._common(other)}")
        return self.join(other)

    def _semi(self, other: Relation, by: Mapping[str, str] | None, how: str) -> Relation:
        on = dict(by) if by else {c: c for c in self._common(other)}
        right = other.df.select(*(F.col(b).alias(f"__{b}") for b in on.values())) if on else other.df.limit(1).select()
        condition = [self.df[a] == right[f"__{b}"] for a, b in on.items()] or F.lit(True)
        return replace(self, df=self.df.join(right, condition, how))

    def having(self, other: Relation, by: Mapping[str, str] | None = None) -> Relation:
        """Rows with a match. Without common columns: all rows, if other has any."""
        return self._semi(other, by, "left_semi")

    def without(self, other: Relation, by: Mapping[str, str] | None = None) -> Relation:
        return self._semi(other, by, "left_anti")

    def divide(self, other: Relation) -> Relation:
        """The rows over the remaining columns that meet every row of other, nil
        equal to nil: those that meet as many as there are. Each row meets one
        row of other at most, so this is one join and one count by group."""
        rest = [c for c in self.columns if c not in other.columns]
        each = other.over(*[c for c in self.columns if c in other.columns])
        whole = self if self.keys else Relation.of(self.df)
        named = each.df.toDF(*(f"__{c}" for c in each.columns)).withColumn("__met", F.lit(1))
        met = whole.df.join(named, [whole.df[c].eqNullSafe(named[f"__{c}"]) for c in each.columns], "left")
        counts = met.groupBy(*rest).agg(F.count("__met").alias("__n"))
        return Relation(counts.where(F.col("__n") == each.df.agg(F.count(F.lit(1))).scalar()).select(*rest), frozenset([Key(rest)]))

    # Sets: columns meet by name, nil equals nil

    def _reconciled(self, other: Relation) -> tuple[DataFrame, DataFrame]:
        """Both sides with other's columns in the order of these, of one type each."""
        if set(self.columns) != set(other.columns):
            raise ValueError(f"the sides have different columns: {sorted(set(self.columns) ^ set(other.columns))}")
        left, right = dict(self.df.dtypes), dict(other.df.dtypes)
        kinds = {c: common_type(left[c], right[c]) for c in self.columns}
        as_kind = lambda df, own: df.select(*(F.col(f"`{c}`") if own[c] == kinds[c] else F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in self.columns))
        return as_kind(self.df, left), as_kind(other.df, right)

    def union(self, other: Relation) -> Relation:
        left, right = self._reconciled(other)
        return self._made(left.unionByName(right), [])

    def minus(self, other: Relation) -> Relation:
        left, right = self._reconciled(other)
        return Relation(left.subtract(right), self.keys or frozenset([Key(self.columns)]))

    def intersect(self, other: Relation) -> Relation:
        left, right = self._reconciled(other)
        return Relation(left.intersect(right), _least([*self.keys, *other.keys]) or frozenset([Key(self.columns)]))

    def within(self, other: Relation) -> Column:
        """Whether every row is one of other's, as a column for use in a plan."""
        return ~self.minus(other).df.exists()

    def comparison(self, other: Relation) -> DataFrame:
        """One row with every comparison of the two sets, as a plan."""
        a, b = self.within(other), other.within(self)
        flags = self.df.sparkSession.range(1).select(a.alias("a"), b.alias("b"))
        return flags.selectExpr(
            "a and b as equal", "not (a and b) as different", "a as subset", "a and not b as proper_subset", "b as superset",
            "b and not a as proper_superset", "case when a and b then 0 when a then -1 when b then 1 end as compared")

    def subset_of(self, other: Relation) -> bool:
        return self.minus(other).df.isEmpty()

    def superset_of(self, other: Relation) -> bool:
        return other.subset_of(self)

    def equals(self, other: Relation) -> bool:
        return self.subset_of(other) and other.subset_of(self)

    def differs(self, other: Relation) -> bool:
        return not self.equals(other)

    def proper_subset_of(self, other: Relation) -> bool:
        return self.subset_of(other) and not other.subset_of(self)

    def proper_superset_of(self, other: Relation) -> bool:
        return other.proper_subset_of(self)

    def compare(self, other: Relation) -> int:
        """0 if equal, -1 within, 1 otherwise around; unrelated sets raise."""
        within, around = self.subset_of(other), other.subset_of(self)
        if not (within or around):
            raise ValueError("neither set contains the other")
        return 0 if within and around else -1 if within else 1

    def member(self, name: str, other: Relation, by: Mapping[str, str]) -> Relation:
        """A new column: whether the row's columns are a row of other's.

        With one column the rule of scalars holds: nil is in no set for sure, nor
        is a value in a set with a nil, but for a match. More columns are rows,
        where nil equals nil.
        """
        hit = other.over(*by.values()).df.toDF(*(f"__{b}" for b in by.values())).withColumn("__hit", F.lit(True))
        alike = (lambda a, b: self.df[a] == hit[f"__{b}"]) if len(by) == 1 else (lambda a, b: self.df[a].eqNullSafe(hit[f"__{b}"]))
        met = self.df.join(hit, [alike(a, b) for a, b in by.items()], "left")
        found = F.coalesce("__hit", F.lit(False))
        if len(by) == 1:
            (a, b), = by.items()
            unsure = (self.df[a].isNull() & other.df.exists()) | other.df.where(F.col(f"`{b}`").isNull()).exists()
            found = F.when(F.col("__hit"), True).when(~unsure, False)
        return Relation(met.select(*(self.df[c] for c in self.columns), found.alias(name)), self.keys)

    def exists(self) -> bool:
        return not self.df.isEmpty()

    def row(self) -> dict | None:
        """The only row; none gives nil, more than one is an error."""
        rows = self.df.take(2)
        if len(rows) > 1:
            raise ValueError("the relation has more than one row")
        return rows[0].asDict() if rows else None

    def value(self, name: str) -> Column:
        """A column of the only row, for use in another plan; none gives nil."""
        return self.df.select(F.col(f"`{name}`")).scalar()

    # Groups

    def group(self, by: Iterable[str] = (), **made: Column | Callable[[DataFrame], Column]) -> Relation:
        """Aggregates by columns, nil equal to nil; without `by` one row always.
        An aggregate may be a function of the frame, where it needs its types."""
        by = list(by)
        if not made:
            return Relation(self.df.select(*by).distinct(), frozenset([Key(by)]))
        built = [(e if isinstance(e, Column) else e(self.df)).alias(n) for n, e in made.items()]
        return Relation(self.df.groupBy(*by).agg(*built), frozenset([Key(by)]))

    def aggregate(self, by: Iterable[str], name: str, of: Iterable[str], start: Column, step: Callable[[Column, Column], Column],
                  merge: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None, parts: int = 32) -> Relation:
        """A user's aggregate of one or more columns, given to `step` as a row.

        Groups are cut in parts by a hash of the rows, stepped through apart and
        merged, so no task holds more than one part of a group. `merge` must not
        depend on an order.
        """
        by, row = list(by), F.struct(*of)
        cut = self.df.withColumn("__part", F.pmod(F.xxhash64(*self.columns), F.lit(parts)))
        states = cut.groupBy(*by, "__part").agg(F.aggregate(F.collect_list(row), start, step).alias("__state"))
        merged = F.aggregate(F.collect_list("__state"), start, merge, finish)
        return Relation(states.groupBy(*by).agg(merged.alias(name)), frozenset([Key(by)]))

    # Order

    def order(self, *by: str, sort: Callable[[str], Column] | None = None, sequence: str | None = None) -> Relation:
        """Order by columns, '-name' descending; nil is least. `sort` makes the
        value to order by. `sequence` names a column of numbers from 1."""
        wanted = tuple((c.removeprefix("-"), not c.startswith("-")) for c in by)
        made = [self._sort(c, up, sort) for c, up in wanted]
        if sequence and not any(k <= {c for c, _ in wanted} for k in self.keys):
            warnings.warn(f"no key is within the order {by}: numbers of equal rows may swap", stacklevel=2)
        if sequence:
            df = numbered(self.df, made, sequence)
            return Relation(df, _least([*self.keys, Key([sequence])]), ((sequence, True),))
        return replace(self, df=self.df.orderBy(*made), ordering=wanted)

    @staticmethod
    def _sort(name: str, up: bool, sort: Callable[[str], Column] | None = None) -> Column:
        value = sort(name) if sort else F.col(name)
        return value.asc_nulls_first() if up else value.desc_nulls_last()

    def browse(self, *by: str, after: Mapping[str, object] | None = None, before: Mapping[str, object] | None = None, page: int = 100) -> Relation:
        """One page in the order, behind a row or before it: a range filter, a
        sort and a limit, never a materialised cursor. Nil is least, so it comes
        first upwards and last downwards."""
        wanted = [(c.removeprefix("-"), not c.startswith("-")) for c in by]
        edge, forwards = (after, True) if before is None else (before, False)
        df = self.df
        if edge:
            past, equal = F.lit(False), F.lit(True)
            for c, up in wanted:
                own, at = F.col(c), edge[c]
                if up == forwards:
                    beyond = own.isNotNull() if at is None else own > F.lit(at)
                else:
                    beyond = F.lit(False) if at is None else (own < F.lit(at)) | own.isNull()
                past |= equal & beyond
                equal &= own.eqNullSafe(F.lit(at))
            df = df.where(F.coalesce(past, F.lit(False)))
        sorts = [self._sort(c, up) for c, up in wanted]
        if not forwards:
            df = df.orderBy(*(self._sort(c, not up) for c, up in wanted)).limit(page)
            return Relation(df.orderBy(*sorts), self.keys, tuple(wanted))
        return Relation(df.orderBy(*sorts).limit(page), self.keys, tuple(wanted))

    def quota(self, n: int | None, *by: str) -> Relation:
        """The rows of the first n different order values, all ties included;
        nil n gives none. Without `by` a key is the order.

        The n values are found first (distinct values, a sorted limit) and are
        met with the rows, so no task sorts them all."""
        if n is None:
            return replace(self, df=self.df.limit(0))
        by = by or tuple(sorted(min(self.keys or [Key(self.columns)], key=lambda k: (len(k), sorted(k)))))
        wanted = [(c.removeprefix("-"), not c.startswith("-")) for c in by]
        values = self.df.select(*(c for c, _ in wanted)).distinct().orderBy(*(self._sort(c, up) for c, up in wanted)).limit(n)
        named = values.toDF(*(f"__{c}" for c, _ in wanted))
        return replace(self, df=self.df.join(named, [self.df[c].eqNullSafe(named[f"__{c}"]) for c, _ in wanted], "left_semi"))

    # Hierarchies

    def explode(self, root: Column | str, by: tuple[str, str] | Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
                order: Iterable[str] = (), level: str = "level", sequence: str = "sequence", most: int = 100) -> Relation:
        """Depth-first expansion: rows where `root` holds, then for each row its
        children. `by` is a pair of columns, the child's second equal to the
        parent's first, or a condition made from the parent's and the child's
        columns. A row comes once for every path; `level` counts from 1,
        `sequence` is the preorder. Deeper than `most` is an error.

        Rows are numbered once in the order of siblings (by `order`, then all
        columns), so a path is an array of numbers. One join a level over the
        frontier, whose last is found when the next is empty.
        """
        first = list(order)
        rows = durable(numbered(self.df, [F.col(f"`{c}`") for c in [*first, *(c for c in self.columns if c not in first)]], "__own"))
        met = by if callable(by) else lambda parent, child: parent(by[0]) == child(by[1])
        front = durable(rows.where(root).select("*", F.lit(1).alias(level), F.array("__own").alias("__path")))
        done = front
        above = {c: f"__above_{c}" for c in [*self.columns, "__path"]}
        for depth in range(2, most + 2):
            up = front.select(*(F.col(f"`{c}`").alias(a) for c, a in above.items()))
            condition = met(lambda c: F.col(f"`{above[c]}`"), lambda c: F.col(f"`{c}`"))
            front = durable(rows.join(up, condition).select(
                *(F.col(f"`{c}`") for c in self.columns), "__own", F.lit(depth).alias(level), F.concat("__above___path", F.array("__own")).alias("__path")))
            if front.isEmpty():
                break
            if depth > most:
                raise RecursionError(f"a path is longer than {most}: is there a cycle?")
            done = done.unionByName(front)
        df = numbered(done, [F.col("__path")], sequence).drop("__own", "__path")
        return Relation(df, frozenset([Key([sequence])]), ((sequence, True),))

    def copy(self) -> Relation:
        """Held in memory or on disk for further use."""
        return replace(self, df=self.df.persist())
