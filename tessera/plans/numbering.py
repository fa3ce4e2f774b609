"""Cuts of lineage and row numbers over a whole frame, without a single task."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    A session on one machine that names none gets one under /tmp; a session on
    a cluster must name one, since its machines share no local folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "/tmp/tessera-checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder once, so a
    lost executor costs a read and not a new computation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: Iterable[Column], name: str, start: int = 1) -> DataFrame:
    """Numbers from `start` in the order.

    Rows are range-partitioned, sorted and written once; each partition's own
    numbers start behind the counts of those before it. Only these counts, one
    row a partition, meet in one task.
    """
    order, n = list(order), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    number = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + start
    # At most n rows, whatever the data's size.
    return placed.join(F.broadcast(before), "__part").withColumn(name, number).drop("__part", "__at", "__before")
