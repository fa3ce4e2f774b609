"""SELECT with set semantics over registered relations."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .plans import Relation


def select(spark: SparkSession, text: str, *keys: tuple[str, ...], **relations: Relation) -> Relation:
    """The rows of a SELECT as a set. Declared keys of the result spare the
    distinct. Each name is a view for this statement only."""
    return Relation.of(spark.sql(text, **{k: r.df for k, r in relations.items()}), *keys)
