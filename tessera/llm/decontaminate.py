"""Benchmark decontamination by winnowing.

A window is 13 words of a benchmark item, or the whole of a shorter item. Of
every window the least k-gram hash is its fingerprint, and windows of documents
are fingerprinted the same way, so a window that a document shares with an
item has the item's fingerprint, wherever it stands. Hits on fingerprints are
extended to the window that each stands for, and these windows are joined in
Spark with those of the benchmark by two hashes of all their words.

What is found depends on the text alone, so it is carried by a hash of the
text and put beside each input row at the end: null and repeated ids are rows
like any other, and texts are never shuffled. The fingerprints of the benchmark
are sent to all tasks PRINTS_AT_ONCE at a time, each in a pass of its own; a
benchmark of up to some ten million words needs one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, fresh, table, written

WINDOW, GRAM = 13, 5
#: Fingerprints of the benchmark in one broadcast, and texts told bad in one: 8 bytes each.
PRINTS_AT_ONCE, BAD_AT_ONCE = 2_000_000, 1_000_000
#: Parts that the rows of a window with one in HOT_SHARE of all candidates are dealt to.
SALTS = 64
#: Bytes of text whose words are hashed together.
SLICE_BYTES = 1 << 18
_BASE, _MIX, _PLACE = 0x5851F42D4C957F2D, np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Speech:
    """Texts as arrays: a hash of every word, and the text it belongs to.

    A word's hash is a polynomial of its lower-cased bytes over 64 bits, mixed;
    all words of a slice of texts are hashed together.
    """

    def __init__(self):
        signs = np.arange(256, dtype=np.uint64)
        upper = (signs >= 65) & (signs <= 90)
        self.low = np.where(upper, signs + np.uint64(32), signs) + np.uint64(1)
        self.spoken = (signs >= 128) | ((signs >= 48) & (signs <= 57)) | ((signs >= 97) & (signs <= 122)) | upper
        self.up = self.down = np.empty(0, np.uint64)

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(texts, hashes, text of each word) for SLICE_BYTES at a time."""
        texts = pa.array(texts).cast(pa.binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if texts.null_count:
            texts = pa.array([x.as_py() or b"" for x in texts], pa.binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int32).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            yield to - at, *self._words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to

    def _words(self, s: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= len(s):
            self.up, self.down = _powers(_BASE, len(s) * 2 + 1), _powers(pow(_BASE, -1, 1 << 64), len(s) * 2 + 1)
        inside = np.zeros(len(s) + 2, np.int8)
        inside[1:-1] = self.spoken[s]
        starts, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
        # A text's end also ends a word.
        cuts = bounds[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(s))])
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        if len(cuts):
            starts, ends = np.sort(np.append(starts, cuts)), np.sort(np.append(ends, cuts))
        total = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(self.low[s] * self.up[: len(s)], out=total[1:])
        h = (total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        return h, np.searchsorted(bounds, starts, "right") - 1


def gram_hashes(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of every run of `width` words."""
    n = len(h) - width + 1
    return run_hashes(h, np.arange(n), width, seed) if n > 0 else np.empty(0, np.uint64)


def run_hashes(h: np.ndarray, starts: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of the `width` words from each start."""
    out = np.full(len(starts), seed, np.uint64)
    for k in range(width):
        out = (out ^ h[starts + k]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """For every `span` neighbours the place of the least (then rightmost) hash."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    if len(grams) > int(_PLACE):  # places fit the low bits piece by piece; pieces overlap
        step = int(_PLACE) - span
        return np.concatenate([winnow(grams[k : k + step + span - 1], span) + k for k in range(0, n, step)])
    ranked = (grams & ~_PLACE) | (_PLACE - np.arange(len(grams), dtype=np.uint64))
    rows = -(-len(grams) // span)
    padded = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(grams)] = ranked
    blocks = padded.reshape(rows, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (_PLACE - (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & _PLACE)).astype(np.int64)


def prints_of(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, place): hashes of word runs, and each window's fingerprint among them."""
    gram = min(GRAM, width)
    grams = gram_hashes(h, gram)
    return grams, winnow(grams, width - gram + 1)


_CODES = "width int, code long, again long"
_FOUND = "array<struct<width:int,code:long,again:long,start:long>>"


def _codes(h: np.ndarray, starts: np.ndarray, width: int) -> list[pa.Array]:
    return [pa.array(np.full(len(starts), width, np.int32)), *(pa.array(run_hashes(h, starts, width, seed).view(np.int64)) for seed in (0, 1))]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    speech = Speech()
    for batch in batches:
        at = 0
        for n, h, owner in speech.slices(batch.column(1)):
            bounds = np.searchsorted(owner, np.arange(n + 1))
            for k in range(n):
                own = h[bounds[k] : bounds[k + 1]]
                if len(own):
                    width = min(WINDOW, len(own))
                    grams, place = prints_of(own, width)
                    starts = np.arange(len(place))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(np.full(len(place), at + k))), pa.array(grams[place].view(np.int64)), *_codes(own, starts, width)],
                        names=["item", "print", "width", "code", "again"])
            at += n


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    k = np.searchsorted(ordered, values)
    return (k < len(ordered)) & (ordered[np.minimum(k, len(ordered) - 1)] == values)


def _candidates(prints):
    """Of each text its words' number and the windows whose fingerprint is one of
    the benchmark's. `prints` are plain arrays by width, broadcast."""
    window = pa.struct([("width", pa.int32()), ("code", pa.int64()), ("again", pa.int64()), ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speech = Speech()
        for batch in batches:
            *others, texts = batch.columns
            sizes, found = [], []
            for n, h, owner in speech.slices(texts):
                first = np.searchsorted(owner, np.arange(n + 1))
                sizes.append(np.diff(first))
                rows = [[] for _ in range(n)]
                for width, known in prints.value.items():
                    grams, place = prints_of(h, width)
                    fresh = np.append(True, place[1:] != place[:-1]) if len(place) else np.empty(0, bool)
                    met = _among(grams[place[fresh]].view(np.int64), known)[np.cumsum(fresh) - 1]
                    starts = np.flatnonzero(met)
                    starts = starts[owner[starts] == owner[starts + width - 1]]
                    columns = [c.to_pylist() for c in _codes(h, starts, width)]
                    for own, start, *codes in zip(owner[starts].tolist(), (starts - first[owner[starts]]).tolist(), *columns, strict=True):
                        rows[own].append((*codes, start))
                found += rows
            yield pa.RecordBatch.from_arrays(
                [*others, pa.array(np.concatenate([*sizes, np.empty(0, np.int64)]).astype(np.int64)), pa.array(found, pa.list_(window))],
                names=[*batch.schema.names[:-1], "n_words", "found"])

    return run


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def _scanned(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): doc_id, key and n_words of every row; and (key, n_words,
    width, code, again, start) of windows that may be an item's, by the text's key."""
    spark = docs.sparkSession
    prints = windows.select("width", "print").distinct()
    passes = max(1, -(-prints.count() // PRINTS_AT_ONCE))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(_text(text_col)).alias("key"), _text(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    made = []
    for k in range(passes):
        part = prints.where(F.pmod(F.xxhash64("print", F.lit("pass")), F.lit(passes)) == k).toArrow()
        width, values = (part.column(c).to_numpy() for c in ("width", "print"))
        sent = spark.sparkContext.broadcast({int(w): np.sort(values[width == w]) for w in np.unique(width)})
        made.append(written(texts.mapInArrow(_candidates(sent), f"doc_id {kind}, key long, n_words long, found {_FOUND}"), "scan"))
        sent.destroy()
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    hits = every.where("size(found) > 0").select("key", "n_words", F.explode("found").alias("x")).select("key", "n_words", "x.*")
    return made[0].select("doc_id", "key", "n_words"), hits


def _hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, found): rows as above; and for each text with an occurrence of a
    window (key, n_words, n_hit, items)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), _text("text").alias("text"))
    windows = written(items.mapInArrow(_item_windows, f"item string, print long, {_CODES}").distinct(), "windows")
    rows, near = _scanned(docs, windows, id_col, text_col)
    on = ["width", "code", "again"]
    near = written(near.distinct(), "near")
    # A window that many texts hold is dealt by text, and the benchmark's side repeated for each part.
    counts = near.groupBy(*on).agg(F.count(F.lit(1)).alias("c"))
    hot = written(counts.where(F.col("c") * HOT_SHARE >= near.count()).where("c > 1").select(*on, F.lit(SALTS).alias("salts")), "hot")
    salted = near.join(F.broadcast(hot), on, "left").withColumn("salt", F.pmod(F.xxhash64("key"), F.coalesce("salts", F.lit(1)).cast("long"))).drop("salts")
    asked = (windows.groupBy(*on).agg(F.collect_set("item").alias("items")).join(F.broadcast(hot), on, "left")
             .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1))).drop("salts"))
    span = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("width")).alias("stop"))))
    begun = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate("spans", begun, lambda s, x: F.struct(
        (s["n"] + F.greatest(x["stop"] - F.greatest(x["start"], s["end"]), F.lit(0).cast("long"))).alias("n"),
        F.greatest(s["end"], x["stop"]).alias("end")), lambda s: s["n"])
    found = (salted.join(asked, [*on, "salt"]).groupBy("key", "n_words")
             .agg(span.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
             .select("key", "n_words", covered.alias("n_hit"), "items"))
    return rows, found


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256), a row per input row.

    Null texts have no words; items without words have no windows; an item
    without item_id counts under the empty name; repeated items count once.
    Rows of equal or missing doc_id are judged each by its own text. An empty
    table gives no rows, an empty benchmark rows without hits. Other columns
    are ignored.
    """
    rows, found = _hits(docs, benchmark, id_col, text_col)
    names = F.coalesce(F.array_join("items", ","), F.lit(""))
    return rows.join(found, ["key", "n_words"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"))


def contaminated() -> Column:
    return F.expr("n_hit > 0 and 20 * n_hit >= n_words")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns and as
    often as they are given; null and repeated ids as in :func:`overlaps`.

    Texts told bad are joined away by their hash. Up to BAD_AT_ONCE of them,
    which is counted, the documents are filtered where they are read.
    """
    _, found = _hits(docs.select("doc_id", "text"), benchmark, "doc_id", "text")
    bad = written(found.where(contaminated()).select("key").distinct(), "bad")
    key = fresh("key", docs)
    few, bad = bad.count() <= BAD_AT_ONCE, bad.withColumnRenamed("key", key)
    return docs.withColumn(key, F.xxhash64(_text("text"))).join(F.broadcast(bad) if few else bad, key, "left_anti").select(docs.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", contaminated())


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLE_SQL = {"op5_decontaminate": r"""
WITH spoken AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
asked AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, width, array_to_string(w[k : k + width - 1], ' ') AS t
  FROM (SELECT item, w, least(len(w), 13) AS width, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM asked WHERE len(w) > 0)),
places AS (
  SELECT doc_id, width, k, array_to_string(w[k : k + width - 1], ' ') AS t
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS k
        FROM spoken, (SELECT DISTINCT width FROM windows) WHERE len(w) >= width)),
met AS (SELECT DISTINCT doc_id, width, k, item FROM places JOIN windows USING (width, t)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + width)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM spoken LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""}
