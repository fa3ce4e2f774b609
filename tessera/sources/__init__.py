"""Where relations come from and go: files, databases, literals, upserts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import Relation
from .remote import available_references, available_tables, database, execute, next_generator, store

__all__ = [
    "available_references", "available_tables", "copy", "create_from", "database", "execute", "files", "key_violations", "listing", "literal", "next_generator",
    "parquet", "row_violations", "save", "store", "text_file", "transition_violations", "upsert", "view", "violations",
]


def parquet(spark: SparkSession, path: str, *keys: Iterable[str]) -> Relation:
    return Relation.of(spark.read.parquet(path), *keys)


def files(spark: SparkSession, path: str, kind: str, *keys: Iterable[str], **options) -> Relation:
    """csv, json, orc, text (lines), xml or binaryFile (whole files and their listing)."""
    return Relation.of(spark.read.format(kind).options(**options).load(path), *keys)


def view(spark: SparkSession, name: str, relation: Relation) -> Relation:
    """Named for SQL; the view is its expression, expanded wherever it stands."""
    relation.df.createOrReplaceTempView(name)
    return Relation(spark.table(name), relation.keys)


def text_file(spark: SparkSession, path: str) -> Relation:
    """(path, text) of whole files."""
    df = spark.read.format("binaryFile").load(path)
    return Relation.of(df.select("path", F.decode("content", "UTF-8").alias("text")), ["path"])


def listing(spark: SparkSession, path: str) -> Relation:
    """(path, length, modified) of files; their contents aren't read."""
    df = spark.read.format("binaryFile").load(path)
    return Relation.of(df.select("path", "length", F.col("modificationTime").alias("modified")), ["path"])


def literal(spark: SparkSession, rows: list, schema: str, *keys: Iterable[str]) -> Relation:
    """A constant relation; a repeated key is an error, repeated rows without keys are one."""
    for key in keys:
        names = [x.strip().split()[0] for x in schema.split(",")]
        seen = [tuple(r[names.index(k)] for k in key) for r in rows]
        if len(set(seen)) < len(seen):
            raise ValueError(f"rows repeat the key {tuple(key)}")
    return Relation.of(spark.createDataFrame(rows, schema), *keys)


def save(relation: Relation, path: str, kind: str = "parquet", partition_by: Iterable[str] = (), mode: str = "error") -> None:
    relation.df.write.format(kind).mode(mode).partitionBy(*partition_by).save(path)


def create_from(relation: Relation, path: str) -> Relation:
    """A new table with the rows of an expression and its keys."""
    save(relation, path)
    return Relation(relation.df.sparkSession.read.schema(relation.df.schema).parquet(path), relation.keys)


def copy(target: Relation, rows: Relation, key: Iterable[str], path: str) -> tuple[Relation, int]:
    """The upsert written to a new folder, and how many rows were put in."""
    return create_from(upsert(target, rows, key), path), rows.df.count()


def upsert(target: Relation, rows: Relation, key: Iterable[str]) -> Relation:
    """The target with rows put in by key: those of the same key are replaced."""
    kept = target.df.join(rows.df.select(*key), list(key), "left_anti").select(target.columns)
    return Relation(kept.unionByName(rows.df.select(target.columns)), frozenset([frozenset(key)]))


def violations(child: DataFrame, parent: DataFrame, by: dict[str, str]) -> DataFrame:
    """Rows whose reference meets nothing; a nil in it satisfies it."""
    filled = child.where(" and ".join(f"{c} is not null" for c in by))
    return filled.join(parent, [filled[a] == parent[b] for a, b in by.items()], "left_anti")


def key_violations(df: DataFrame, key: Iterable[str]) -> DataFrame:
    """Key values that come more than once, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def row_violations(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which a condition on each row is false; nil satisfies it."""
    return df.where(~F.coalesce(F.expr(condition), F.lit(True)))


def transition_violations(old: DataFrame, new: DataFrame, key: Iterable[str], condition: str) -> DataFrame:
    """Pairs of an old row and the new one of its key for which a condition on
    `old` and `new` is false."""
    key = list(key)
    before, after = (df.select(*key, F.struct(*(c for c in df.columns)).alias(name)) for df, name in ((old, "old"), (new, "new")))
    return row_violations(before.join(after, key), condition).select("old.*", *(F.col(f"new.{c}").alias(f"new_{c}") for c in new.columns if c not in key))
