"""What the operators share: reading tables, written cuts of lineage, words."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.numbering import durable, numbered, shared_dir

__all__ = ["NOT_ALNUM", "SPACE", "ascii_lower", "durable", "fresh", "lean", "met_by_key", "numbered", "partitions", "remove_written", "shared_path", "table", "words", "written"]

#: ASCII white space, and the inside of a character class of what isn't a word.
SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, df: DataFrame) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a compressed Parquet table in the shared folder: like
    :func:`durable`, with less disk and with columns that can be read alone."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_written(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, after which the worker gives free memory back to the
    system. An executor may have more workers than tasks, and those that wait
    would keep what their last task took."""
    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)

    return then


#: A key with one part in so many of all rows is met by broadcast: there are no more than that.
HOT_SHARE = 1000


def met_by_key(rows: DataFrame, few: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Rows with the columns of `few`, where the keys `on` are unique and `count`
    tells the rows of a key, `total` in all. Keys with one part in HOT_SHARE of
    them are broadcast, and their rows stay out of the shuffle."""
    hot = F.col(count) * HOT_SHARE >= total
    hottest = F.broadcast(few.where(hot))
    return rows.join(hottest, on).unionByName(
        rows.join(F.broadcast(few.where(hot).select(*on)), on, "left_anti").join(few.where(~hot), on))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column, separators: str) -> Column:
    """The maximal runs without separators; null has none."""
    ends = F.regexp_replace(F.coalesce(text, F.lit("")), rf"\A{separators}|{separators}\z", "")
    return F.when(ends == "", F.array().cast("array<string>")).otherwise(F.split(ends, separators))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
