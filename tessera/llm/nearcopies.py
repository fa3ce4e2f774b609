"""Near copies by five-word shingles: Jaccard similarity of 0.8 or more.

SimHash fingerprints of five-word shingles, compared tile by tile (operator 1),
find most copies with few changes; but two texts of similarity 0.8 differ in
ten of 64 bits, beyond a radius that tiles can tell apart. So MinHash bands
propose pairs as well, and a pair is a link only if its shingle sets, counted
in whole, are similar enough. A bucket of n texts first proposes n - 1 pairs,
each text with the bucket's least, and the components of what holds are formed.
Only texts of one bucket that are still in different components are then
compared one with another. A bucket of at most NAMED_ROWS texts names its pairs
by one bit each of a longer signature. A larger one is cut in blocks, which
hold the texts' shingle sets; two blocks meet in one row, their pairs are
counted in whole there, each in the first bucket that has it, and only the
links of a forest leave. A large group of copies is thus one star, a large
group of texts that are less than similar names no pairs, and no pair that a
bucket holds is left out.

Two texts of similarity 0.8 share no bucket with a probability of 5e-8, and
their signatures agree in too few places with one of 2e-6. Texts and shingles
are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import fresh, remove_written, written
from .components import components
from .decontaminate import gram_hashes

WIDTH = 5
BANDS, ROWS = 32, 4
PLACES = BANDS * ROWS
#: Places in which the signatures of a pair agree at least, of PLACES; places of
#: the longer signature, and in how many a pair's bits agree at least.
AGREE, BITS, BITS_AGREE = 72, 1024, 876
#: Texts of a bucket that names its pairs; texts and shingles of a block of a larger one.
NAMED_ROWS, BLOCK_ROWS, BLOCK_SHINGLES = 64, 512, 1 << 17
#: Bits, a power of two, that mark which texts are needed.
MARKED_BITS = 1 << 26
#: Texts signed, and hashes of shingles made, at a time.
TEXTS_AT_ONCE, HASHES_AT_ONCE = 500, 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20_011)
_SALTS, _ODDS = (_RNG.integers(0, 1 << 64, BITS, np.uint64) for _ in range(2))
_ODDS |= np.uint64(1)


def shingles(raw: bytes | None) -> np.ndarray:
    """The distinct shingles' hashes in order; a text of fewer words is one
    shingle, and so is one without words."""
    words = (raw or b"").lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.unique(gram_hashes(h, min(WIDTH, len(h))))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two shingle sets is 0.8 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def signature(found: np.ndarray, places: int = PLACES) -> np.ndarray:
    least = np.full(places, np.iinfo(np.uint64).max, np.uint64)
    step = HASHES_AT_ONCE // places
    for k in range(0, len(found), step):
        np.minimum(least, ((found[k : k + step, None] ^ _SALTS[:places]) * _ODDS[:places]).min(0), out=least)
    return least


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(low, TEXTS_AT_ONCE)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of a text's buckets, and a byte of every place of its signature."""
    for batch in _slices(batches):
        least = np.array([signature(shingles(x.as_py())) for x in batch.column(1)], np.uint64).reshape(-1, PLACES)
        keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(least), BANDS)).copy()
        for k in range(ROWS):
            keys = (keys ^ least[:, k::ROWS]) * _MIX
            keys ^= keys >> np.uint64(29)
        marks = ((least * _MIX) >> np.uint64(56)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())), pa.array([m.tobytes() for m in marks], pa.binary())],
            names=["node", "keys", "marks"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit of every place of a text's longer signature."""
    for batch in _slices(batches):
        made = [np.packbits(((signature(shingles(x.as_py()), BITS) * _MIX) >> np.uint64(63)).astype(np.uint8)).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["node", "bits"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in ("x", "y"))
        yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= AGREE, pa.bool_()))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are compressed before they are shuffled."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(x.as_py()) for x in batch.column(1)], pa.binary())], names=["node", "packed"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        known, keep = {}, []

        def of(node, packed, known=known):
            if node not in known:
                if len(known) > 1000:
                    known.clear()
                known[node] = shingles(unpack(packed.as_py()))
            return known[node]

        for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            keep.append(similar(of(a, x), of(b, y)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a small bucket's texts in different components whose longer
    signatures agree often enough."""
    for batch in batches:
        for i in range(batch.num_rows):
            a, ca = (batch.column(x)[i].values.to_numpy() for x in ("node", "component"))
            ma = np.frombuffer(b"".join(batch.column("bits")[i].as_py()), np.uint64).reshape(-1, BITS // 64)
            for k in range(len(a)):
                near = (a > a[k]) & (ca != ca[k]) & (np.bitwise_count(ma ^ ma[k]).sum(1) <= BITS - BITS_AGREE)
                if near.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(near.sum(), a[k])), pa.array(a[near])], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        found = [shingles(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in found], pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "size", "held"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of a block's texts, one after the other, compressed: near
    copies share most of their hashes."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        made = []
        for lists in zip(*(batch.column(c) for c in ("node", "component", "size", "keys", "marks", "held")), strict=True):
            node, component, size = (x.values.to_numpy() for x in lists[:3])
            keys = lists[3].values.flatten().to_numpy()
            made.append(pack(b"".join([np.int64(len(node)).tobytes(), node.tobytes(), component.tobytes(), size.astype(np.int64).tobytes(), keys.tobytes(),
                                       *lists[4].as_py(), *lists[5].as_py()])))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "block", "blocks")), pa.array(made, pa.binary())], names=["key", "block", "blocks", "packed"])
        del batch, made
        pa.default_memory_pool().release_unused()


def _unpacked_block(packed: bytes) -> tuple[np.ndarray, ...]:
    """(node, component, size, keys, marks, hashes of all sets)."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n, at, found = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind, width in ((np.int64, 1), (np.int64, 1), (np.int64, 1), (np.int64, BANDS), (np.uint8, PLACES)):
        column = np.frombuffer(raw, kind, n * width, at)
        found.append(column if width == 1 else column.reshape(n, width))
        at += column.nbytes
    return *found, np.frombuffer(raw, np.uint64, offset=at)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two blocks' texts, as many as join what is similar: a pair
    that is joined already isn't counted, nor one that an earlier bucket has."""
    for batch in batches:
        for key, x, y in zip(batch.column("key").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
            a = _unpacked_block(x.as_py())
            b = a if y.as_py() is None else _unpacked_block(y.as_py())
            links = list(_joined(key, a, b))
            if links:
                low, high = np.sort(np.array(links, np.int64), 1).T
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])


def _joined(key: int, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> Iterator[tuple[int, int]]:
    (node, component, size, keys, marks, held), (node2, component2, size2, keys2, marks2, held2) = a, b
    vocabulary, numbers = np.unique(np.concatenate([held, held2]), return_inverse=True)
    numbers, numbers2 = numbers[: len(held)], numbers[len(held) :]
    stop, stop2, present = np.cumsum(size), np.cumsum(size2), np.zeros(len(vocabulary), bool)
    # Components are numbered; those that a link joins get one number.
    group = np.unique(np.concatenate([component, component2]), return_inverse=True)[1]
    group, group2 = group[: len(node)], group[: len(node)] if a is b else group[len(node) :]
    for k in range(len(node)):
        near = np.flatnonzero((group2 != group[k]) & (5 * np.minimum(size2, size[k]) >= 4 * np.maximum(size2, size[k])))
        if a is b:
            near = near[near > k]
        near = near[(marks2[near] == marks[k]).sum(1) >= AGREE]
        both = keys2[near] == keys[k]
        near = near[keys[k][both.argmax(1)] == key]
        if not len(near):
            continue
        mine = numbers[stop[k] - size[k] : stop[k]]
        present[mine] = True
        sizes = size2[near]
        first = np.cumsum(sizes) - sizes
        at = np.repeat(stop2[near] - sizes - first, sizes) + np.arange(sizes.sum())
        shared = np.add.reduceat(present[numbers2[at]].astype(np.int64), first)
        present[mine] = False
        for j in near[9 * shared >= 4 * (size[k] + sizes)].tolist():
            if group2[j] != group[k]:
                yield int(node[k]), int(node2[j])
                old = group2[j]
                group[group == old] = group[k]
                group2[group2 == old] = group[k]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")


def _made_of(texts: DataFrame, nodes: DataFrame, run: Callable, schema: str) -> DataFrame:
    """What is made of the texts of these nodes. Marked bits of bounded size,
    broadcast, tell most of the others before any text is shuffled; the join
    tells the rest. It is behind the function so that Spark can't join first."""
    bit = F.pmod("node", F.lit(MARKED_BITS))
    place, at = F.bitmap_bucket_number(bit).alias("place"), F.bitmap_bit_position(bit)
    marked = nodes.groupBy(place).agg(F.bitmap_construct_agg(at).alias("marked"))
    likely = (texts.withColumns({"place": place, "at": at}).join(F.broadcast(marked), "place")
              .where("cast(conv(hex(substring(marked, cast(at div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(at % 8 as int)) <> 0"))
    return likely.select(texts.columns).mapInArrow(run, schema).join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs that are similar."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    held = written(_made_of(texts, needed, _packed, "node long, packed binary"), "held")
    both = (pairs.join(held.select(F.col("node").alias("b"), F.col("packed").alias("y")), "b")
            .join(held.select(F.col("node").alias("a"), F.col("packed").alias("x")), "a"))
    links = written(both.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long"), "links")
    remove_written(held)
    return links


def _links_left(buckets: DataFrame, signed: DataFrame, texts: DataFrame, linked: DataFrame, seen: DataFrame) -> DataFrame:
    """Links between texts of one bucket that are in different components, but
    for the pairs seen."""
    placed = written(buckets.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    mixed = (placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low < high").select("key", "n"))
    open_ = written(placed.join(mixed, "key"), "open")
    few, many = open_.where(F.col("n") <= NAMED_ROWS), open_.where(F.col("n") > NAMED_ROWS)
    of = lambda rows, run, schema: _made_of(texts, rows.select("node").distinct(), run, schema)

    bits = written(of(few, _bits, "node long, bits binary"), "bits")
    lists = lambda *names: [F.col(f"m.{x}").alias(x) for x in names]
    named = few.join(bits, "node").groupBy("key").agg(F.collect_list(F.struct("node", "component", "bits")).alias("m")).select(*lists("node", "component", "bits"))
    pairs = written(named.mapInArrow(_open_pairs, "a long, b long").distinct().join(seen, ["a", "b"], "left_anti"), "pairs")
    found = _links(pairs, texts)

    sets = written(of(many, _sets, "node long, size int, held binary"), "sets")
    sized = many.join(sets.select("node", "size"), "node").groupBy("key").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = (many.select("key", "node", "component").join(sized, "key").join(sets, "node").join(signed.select("node", "keys", "marks"), "node")
               .withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")))
    columns = ("node", "component", "size", "keys", "marks", "held")
    cut = written(members.groupBy("key", "block").agg(F.max("blocks").alias("blocks"), F.collect_list(F.struct(*columns)).alias("m"))
                  .select("key", "block", "blocks", *lists(*columns)).mapInArrow(_blocks, "key long, block int, blocks int, packed binary"), "blocks")
    alone = cut.select("key", F.col("packed").alias("x"), F.lit(None).cast("binary").alias("y"))
    first = cut.where("blocks > 1").withColumn("block2", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).where("block2 > block")
    across = (first.select("key", "block2", F.col("packed").alias("x"))
              .join(cut.select("key", F.col("block").alias("block2"), F.col("packed").alias("y")), ["key", "block2"]).select("key", "x", "y"))
    left = written(found.unionByName(alone.unionByName(across).mapInArrow(_block_links, "a long, b long")), "left")
    remove_written(placed, open_, bits, pairs, found, sets, cut)
    return left


def near_copies(docs: DataFrame) -> DataFrame:
    """(node, component): the texts, by hash, that have a near copy, linked as
    far as similar pairs reach."""
    texts = docs.where("doc_id is not null").select(F.xxhash64(_text()).alias("node"), _text().alias("text"))
    signed = written(texts.mapInArrow(_signed, "node long, keys array<long>, marks binary").dropDuplicates(["node"]), "signed")
    every = signed.select("node", F.explode("keys").alias("key"))
    shared = every.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").drop("most")
    buckets = written(every.join(shared, "key"), "buckets")
    marks = lambda node, name: signed.select(F.col("node").alias(node), F.col("marks").alias(name))
    proposed = buckets.select(F.col("least").alias("a"), F.col("node").alias("b")).unionByName(_simhash_pairs(texts)).where("a <> b").distinct()
    stars = written(proposed.join(marks("b", "y"), "b").join(marks("a", "x"), "a").mapInArrow(_alike, "a long, b long"), "stars")
    links = _links(stars, texts)
    linked = components(links, "a", "b")
    more = _links_left(buckets.drop("least"), signed, texts, linked, stars)
    found = components(linked.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more), "a", "b")
    remove_written(signed, buckets, stars, links, more)
    return found


def _simhash_pairs(texts: DataFrame) -> DataFrame:
    """Texts of one fingerprint with the least of them, and a forest of the
    links between fingerprints."""
    prints = written(simhash.fingerprints(texts, "node", "text", WIDTH).distinct(), "prints")
    least = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "least")
    equal = prints.join(least, "fp").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    return equal.unionByName(simhash.links(least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: the one of least doc_id.

    Rows of equal doc_id are different documents unless their texts are near
    copies; rows without doc_id can't be named as members of a group and stay.
    Of rows equal in id and text the one of least hash of all columns stays.
    Null texts are empty ones, and all empty texts are copies of each other.
    An empty table gives no rows; further columns stay as they are.
    """
    mark, whole = fresh("node", docs), fresh("whole", docs)
    named = docs.where("doc_id is not null").withColumns({mark: F.xxhash64(_text()), whole: F.xxhash64(*(x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))))})
    heads = written(named.groupBy("doc_id", F.col(mark).alias("node")).agg(F.min(whole).alias("row")), "heads")
    first = (heads.join(near_copies(docs), "node", "left")
             .groupBy(F.coalesce("component", "node").alias("component"))
             .agg(F.min(F.struct("doc_id", "node", "row")).alias("head"))
             .select("head.doc_id", F.col("head.node").alias(mark), F.col("head.row").alias(whole)))
    return (named.join(first, ["doc_id", mark, whole]).dropDuplicates(["doc_id", mark, whole]).select(docs.columns)
            .unionByName(docs.where("doc_id is null")))
