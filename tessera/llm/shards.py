"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered in the order of doc_id without a single task
(:func:`tessera.plans.numbering.numbered`). A keyed Feistel network permutes the numbers of
the next power of four; numbers beyond the row count walk on along their cycle
until they fall inside, which keeps it a permutation. The permuted number gives
shard (remainder) and slot (quotient), so either can be computed from the row
number alone, reruns agree, and shard counts are at most one apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered as number_rows
from .common import table

#: Fixed round keys and multiplier: changing them changes every shuffle.
ROUND_KEYS, MULTIPLIER = (0x243F6A88, 0x13198A2E, 0x03707344, 0x299F31D0), 0x9E3779B1


def half_bits(n: int) -> int:
    """Bits of one half, so that the network covers n numbers."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, bits: int, keys: tuple[int, ...]) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & mask
    for key in keys:
        mixed = ((right + np.uint64(key)) * np.uint64(MULTIPLIER)) & np.uint64(0xFFFFFFFFFF)
        left, right = right, left ^ ((mixed >> np.uint64(13)) & mask)
    return (left << np.uint64(bits)) | right


def permute(numbers: np.ndarray, n: int, keys: tuple[int, ...] = ROUND_KEYS) -> np.ndarray:
    """The places of row numbers below n: a permutation of range(n)."""
    bits, x = half_bits(n), _network(numbers.astype(np.uint64), half_bits(n), keys)
    while (out := x >= np.uint64(n)).any():
        x[out] = _network(x[out], bits, keys)
    return x.astype(np.int64)


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", keys: tuple[int, ...] = ROUND_KEYS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row for every input row.

    Null ids come first; rows of equal id are ordered by text checksum and
    size, and equal rows may swap places. A null text has size 1 and checksum
    0. An empty table gives no rows. Other columns are ignored.
    """
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    numbered = number_rows(rows, [F.col(x).asc_nulls_first() for x in ("doc_id", "text_crc32", "size")], "row", 0)
    n = numbered.count()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = permute(batch.column("row").to_numpy(), n, keys)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("doc_id", "size", "text_crc32")), pa.array((at % shards).astype(np.int32)), pa.array(at // shards)],
                names=["doc_id", "size", "text_crc32", "shard", "slot"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return numbered.select("doc_id", "size", "text_crc32", "row").mapInArrow(
        place, f"doc_id {kind}, size long, text_crc32 long, shard int, slot long")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB has no CRC-32; the tests hold the query against a plain loop.
ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op10_sharding": op10_sharding}
