"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Distinct fingerprints are laid into tiles by the population counts of their
four 16-bit quarters. Two fingerprints differ in at least as many bits as those
counts do, so a tile meets only the 41 tiles within the radius and all others
are skipped without a look. Tiles are cut into blocks of bounded size; a pair
of blocks is one row of work (exclusive-or and bit counts in numpy), so a tile
that holds a third of the corpus is many rows. A pair of blocks returns a
spanning forest of its links, never all pairs. The components come from
:mod:`components`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table
from .components import components

QUARTERS, QUARTER_BITS = 4, 16
#: Fingerprints of a block, about: what one side of a comparison holds.
BLOCK_ROWS = 4096
#: Shingles whose bits are counted at a time, and cells of a compared tile.
SHINGLES_AT_ONCE, CELLS_AT_ONCE = 1 << 15, 1 << 21


def fingerprint(raw: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text's UTF-8 bytes; no words give zero."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        spans = [(0, len(joined))]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        spans = list(zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True))
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(spans), SHINGLES_AT_ONCE):
        part = spans[k : k + SHINGLES_AT_ONCE]
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in part), "<u8", len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): one row per input row, fp as a signed 64-bit value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def block_links(a_fp, a_node, b_fp, b_node, same: bool, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one block or between two."""
    n, at = len(a_fp), 0 if same else len(a_fp)
    label = np.arange(n if same else n + len(b_fp))
    found, step = [], max(1, CELLS_AT_ONCE // max(1, len(b_fp)))
    for low in range(0, n, step):
        near = np.bitwise_count(a_fp[low : low + step, None] ^ b_fp[None, :]) <= radius
        for i in np.flatnonzero(near.any(1)).tolist():
            js = np.flatnonzero(near[i])
            labels = label[at + js]
            other, first = np.unique(labels[labels != label[low + i]], return_index=True)
            if len(other):
                partners = js[labels != label[low + i]][first]
                found += [(int(a_node[low + i]), int(b_node[j])) for j in partners]
                label[np.isin(label, other)] = label[low + i]
    return found


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            same = batch.column("same").to_pylist()
            sides = [batch.column(x) for x in ("a_fp", "a_node", "b_fp", "b_node")]
            for i, own in enumerate(same):
                a_fp, a_node, b_fp, b_node = (x[i].values.to_numpy(zero_copy_only=False) for x in sides)
                found += block_links(a_fp.view(np.uint64), a_node, b_fp.view(np.uint64), b_node, own, radius)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def _neighbours(radius: int) -> list[list[int]]:
    """Steps between the population counts of tiles that may hold a link."""
    reach = range(-radius, radius + 1)
    return [list(d) for d in product(reach, repeat=QUARTERS) if sum(map(abs, d)) <= radius]


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links that connect all of (fp, node) within the radius."""
    base = QUARTER_BITS + 1
    quarter = lambda k: F.bit_count(F.shiftrightunsigned("fp", QUARTER_BITS * k).bitwiseAND((1 << QUARTER_BITS) - 1))
    tiled = nodes.withColumn("tile", sum((quarter(k) * base**k for k in range(QUARTERS)), F.lit(0)).cast("int"))
    # At most 17 ** 4 tiles: a bound whatever the corpus.
    sizes = durable(tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")))
    blocks = durable(
        tiled.join(F.broadcast(sizes), "tile")
        .withColumn("block", F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int"))
        .groupBy("tile", "block").agg(F.collect_list("fp").alias("fps"), F.collect_list("node").alias("nodes")))
    step = F.array(*(F.struct(*(F.lit(x).alias(f"d{k}") for k, x in enumerate(d))) for d in _neighbours(radius)))
    digit = lambda k: F.floor(F.col("tile") / base**k) % base + F.col(f"step.d{k}")
    met = (sizes.withColumn("step", F.explode(step))
           .where(" and ".join(f"(floor(tile / {base**k}) % {base} + step.d{k}) between 0 and {QUARTER_BITS}" for k in range(QUARTERS)))
           .withColumn("tile2", sum((digit(k) * base**k for k in range(QUARTERS)), F.lit(0)).cast("int"))
           .where("tile2 >= tile").drop("step"))
    pairs = (met.join(F.broadcast(sizes.select(F.col("tile").alias("tile2"), F.col("blocks").alias("blocks2"))), "tile2")
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("block2", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)))
             .where("tile2 > tile or block2 >= block"))
    work = (pairs.join(blocks.select("tile", "block", F.col("fps").alias("a_fp"), F.col("nodes").alias("a_node")), ["tile", "block"])
            .join(blocks.select(F.col("tile").alias("tile2"), F.col("block").alias("block2"), F.col("fps").alias("b_fp"), F.col("nodes").alias("b_node")), ["tile2", "block2"])
            .select("a_fp", "a_node", "b_fp", "b_node", F.expr("tile = tile2 and block = block2").alias("same")))
    return work.mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every input row.

    Texts without words, null ones included, have fingerprint zero and link
    like any other. A row without doc_id is fingerprinted and takes its
    component from documents with the same fingerprint, or null. Repeated rows
    are returned as often as they come, rows of equal id each with its own
    fingerprint. An empty table gives no rows. Columns besides the two are ignored.
    """
    prints = durable(fingerprints(docs, id_col, text_col, width))
    nodes = durable(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    linked = components(links(nodes, radius), "a", "b")
    classes = nodes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return (prints.join(classes, "fp", "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash}
#: Bit votes over hashed shingles have no SQL form that ends on whole tables.
ORACLE_SQL: dict[str, str] = {}
