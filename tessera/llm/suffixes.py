"""Removal of repeated byte strings by longest-previous-factor arrays.

A string of `length` bytes is a window. All windows of a text are dealt to
anchors: of the grams inside a window the one of least hash is its anchor, so
equal windows have equal anchors, and windows in a row that share one anchor
form a span. Only anchors that come twice can hold a repeat. Of equal spans
(by anchor hash and digest) the first and the last in the order of the corpus
stand for all.

The bytes of an anchor's spans are laid one after the other in that order and
their suffixes are sorted. The nearest smaller positions on either side in
suffix order are where a window's longest previous factor starts, the nearest
larger ones where its longest next factor does: a window whose previous factor
has `length` bytes or more is a later copy, one whose next factor has is an
earlier copy. To keep first copies, later ones go; else both go.

An anchor with more spans than one task should hold is not solved: its spans are
texts of the same problem with longer grams, so they are dealt to anchors that
tell more of a window. Spans that nothing shares such an anchor with drop out
there, others become equal as they get shorter. A gram as long as a window ends
this, since all its spans are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, met_by_key, partitions, remove_written, table, written

LENGTH, GRAM = 200, 32
#: Window starts of a text that are looked at together.
CHUNK = 1 << 20
#: Spans of an anchor that one task solves; bytes of spans sorted at a time.
PART_SPANS, SORTED_BYTES = 2048, 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POSITION = np.uint64((1 << 22) - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= _BASE
    h ^= h >> np.uint64(29)
    return h


class Rolling:
    """Hashes of any slices of a byte array from running sums."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def sums(self, s: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(s):
            self.up, self.down = (_powers(b, len(s) * 5 // 4 + 1) for b in (_BASE, _BACK))
        total = np.zeros(len(s) + 1, np.uint64)
        np.cumsum((s + np.uint64(1)) * self.up[: len(s)], out=total[1:])
        return total

    def slices(self, total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((total[ends] - total[starts]) * self.down[starts])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def text_spans(raw: bytes, length: int, gram: int, rolling: Rolling) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, digest, first window start, windows) of all spans, chunk by chunk."""
    for low in range(0, len(raw) - length + 1, CHUNK):
        s = np.frombuffer(raw, np.uint8, min(CHUNK + length - 1, len(raw) - low), low)
        total = rolling.sums(s)
        grams = _mixed((total[gram:] - total[:-gram]) * rolling.down[: len(s) - gram + 1])
        # The place, rightmost first, stands in the low bits and breaks ties.
        ranked = (grams & ~_POSITION) | (_POSITION - np.arange(len(grams), dtype=np.uint64))
        chosen = _POSITION - (_sliding_min(ranked, length - gram + 1) & _POSITION)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        count = np.diff(np.append(first, len(chosen)))
        yield grams[chosen[first].astype(np.int64)], rolling.slices(total, first, first + count + (length - 1)), first + low, count


def _anchors(length: int, gram: int, kept: int):
    """Spans of texts; the columns before the text are carried along."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            rows, columns, sized = [], [[], [], [], []], 0
            for k, text in enumerate(batch.column(kept)):
                for found in text_spans(text.as_py(), length, gram, rolling):
                    for column, values in zip(columns, found, strict=True):
                        column.append(values)
                    rows.append(np.full(len(found[0]), k))
                    sized += len(found[0])
                if sized > 200_000 or k == batch.num_rows - 1 and rows:
                    h, s, low, n = map(np.concatenate, columns)
                    at = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(at) for c in range(kept)), pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(low), pa.array(n.astype(np.int32))],
                        names=[*batch.schema.names[:kept], "h", "s", "low", "n"])
                    rows, columns, sized = [], [[], [], [], []], 0

    return lean(run)


# Suffix order and factors

def suffix_order(text: np.ndarray, starts: np.ndarray, length: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(order, kind): the windows that have one of equal hash, in the order of their
    suffixes cut off at `length` bytes, equal ones in the order of their places,
    and a number for each kind of window.

    A window whose rolling hash comes once has no equal one. The others are
    compared byte by byte with one of their hash, and one of each kind is sorted.
    """
    hashes = rolling.slices(rolling.sums(text), starts, starts + length)
    by = np.argsort(hashes)
    same = hashes[by[1:]] == hashes[by[:-1]]
    by = by[np.append(same, False) | np.append(False, same)]
    if not len(by):
        return by, by
    by.sort()
    head, kind = np.unique(hashes[by], return_index=True, return_inverse=True)[1:]
    ahead = np.append(text, np.zeros(8, np.uint8))
    eights = np.lib.stride_tricks.sliding_window_view(ahead, 8)[: len(text)].copy().view(">u8").ravel().astype(np.uint64)
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    mine, first = starts[by], starts[by[head]][kind]
    odd = np.zeros(len(by), bool)
    for step in steps:
        odd |= eights[mine + step] != eights[first + step]
    if odd.any():  # one hash, other bytes
        windows = np.lib.stride_tricks.sliding_window_view(text, length)[mine[odd]]
        kind[odd] = len(head) + np.unique(np.ascontiguousarray(windows).view(f"V{length}").ravel(), return_inverse=True)[1]
        head, kind = np.unique(kind, return_index=True, return_inverse=True)[1:]
    rank = _byte_order(eights, starts[by[head]], steps)[kind]
    order = np.lexsort((by, rank))
    return by[order], rank[order]


def _byte_order(eights: np.ndarray, places: np.ndarray, steps: list[int]) -> np.ndarray:
    """Ranks of the windows at these places, eight bytes after eight while some are tied."""
    rank, tied = np.zeros(len(places), np.int64), np.arange(len(places))
    for step in steps:
        word = eights[places[tied] + step]
        order = np.lexsort((word, rank[tied]))
        tied, word = tied[order], word[order]
        old, at = rank[tied], np.arange(len(tied))
        group = np.append(True, old[1:] != old[:-1])
        run = group | np.append(True, word[1:] != word[:-1])
        started = np.maximum.accumulate(np.where(run, at, 0))
        rank[tied] = old + started - np.maximum.accumulate(np.where(group, at, 0))
        alone = run & np.append(run[1:], True)
        tied = tied[~alone]
        if not len(tied):
            break
    return rank


def nearest_smaller(values: np.ndarray, kind: np.ndarray, back: bool) -> np.ndarray:
    """For each place of a suffix order the nearest earlier (or later) one of
    its kind whose value is smaller, else -1; by pointer jumping."""
    n, step = len(values), -1 if back else 1
    at = np.arange(n) + step
    while True:
        inside = (at >= 0) & (at < n)
        inside[inside] = kind[at[inside]] == kind[np.flatnonzero(inside)]
        at[~inside] = -1
        larger = np.flatnonzero(inside)
        larger = larger[values[at[larger]] >= values[larger]]
        if not len(larger):
            return at
        at[larger] = at[at[larger]]


def factors(text: np.ndarray, starts: np.ndarray, length: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(previous, next): for which windows the longest previous, and the longest
    next factor has `length` bytes or more."""
    order, kind = suffix_order(text, starts, length, rolling)
    found = np.zeros((2, len(starts)), bool)
    for row, places in zip(found, (starts[order], -starts[order]), strict=True):
        row[order] = (nearest_smaller(places, kind, True) >= 0) | (nearest_smaller(places, kind, False) >= 0)
    return found[0], found[1]


def _ranges(mask: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()


def _solve(length: int, keep_first: bool):
    """Ranges of windows that go, for spans sorted by anchor, part and place; spans
    of anchors in several parts are passed on with place and bytes."""
    rolling = Rolling()

    def made(rows: list[tuple], crowd: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), crowd)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "s", "last", "cut", "crowd"])

    def solve(spans: list[tuple], crowd: pa.DataType) -> pa.RecordBatch:
        sizes = np.array([len(raw) for *_, raw in spans], np.int64)
        bases, counts = np.cumsum(sizes) - sizes, sizes - length + 1
        starts = np.repeat(bases - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        earlier, later = factors(np.frombuffer(b"".join(raw for *_, raw in spans), np.uint8), starts, length, rolling)
        gone, stops, rows = earlier if keep_first else earlier | later, np.cumsum(counts), []
        for (h, s, last, _), n, stop in zip(spans, counts.tolist(), stops.tolist(), strict=True):
            if cut := _ranges(gone[stop - n : stop]):
                rows.append((h, s, last, cut, None))
        return made(rows, crowd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passed, size, group, seen, crowd = [], [], 0, None, None, None
        for batch in batches:
            crowd = pa.struct([batch.schema.field(c) for c in ("order", "row", "low", "raw")])
            names = ("h", "part", "s", "last", "parts", "order", "row", "low", "raw")
            for h, part, s, last, parts, order, row, low, raw in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (h, part) != group:
                    group = h, part
                    if size >= SORTED_BYTES:
                        yield solve(held, crowd)
                        held, size = [], 0
                if (h, part, s, last, row, low) != seen:  # rows equal in all give one span again
                    seen = h, part, s, last, row, low
                    if parts > 1:
                        passed.append((h, s, last, [], {"order": order, "row": row, "low": low, "raw": raw}))
                    else:
                        held.append((h, s, last, raw))
                        size += len(raw)
            if passed:
                yield made(passed, crowd)
                passed = []
        if held:
            yield solve(held, crowd)

    return lean(run)


# Texts on their way

@lean
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, texts, is compressed before it is shuffled."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        names, texts, size = [*batch.schema.names[:-1], "packed"], [], 0
        for n, text in enumerate(batch.column(batch.num_columns - 1), 1):
            texts.append(pack(text.as_py()))
            size += len(texts[-1])
            if size > SORTED_BYTES or n == batch.num_rows:
                others = batch.slice(n - len(texts), len(texts)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*others, pa.array(texts, pa.binary())], names=names)
                texts, size = [], 0


def _cut_spans(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows, size = [], 0
            types = batch.schema.field("wanted").type.value_type.field("order").type, batch.schema.field("row").type
            for row, packed, wanted in zip(batch.column("row").to_pylist(), batch.column("packed"), batch.column("wanted"), strict=True):
                raw = unpack(packed.as_py())
                for x in wanted.as_py():
                    rows.append((*(x[c] for c in ("h", "part", "parts", "s", "last", "order")), row, x["low"], raw[x["low"] : x["low"] + x["n"] + length - 1]))
                    size += x["n"] + length
                if size > SORTED_BYTES:
                    yield _spans_batch(rows, *types)
                    rows, size = [], 0
            yield _spans_batch(rows, *types)

    return lean(run)


_SPAN = ("h", "part", "parts", "s", "last", "order", "row", "low", "raw")


def _spans_batch(rows: list, order: pa.DataType, row: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 9
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), order, row, pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_SPAN)


def repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, gram: int | None = None) -> DataFrame:
    """(row, cuts): for each row with repeats its removed byte ranges.

    `docs` has row (a key of documents), order (what the first copy is the
    first by) and text (binary, not null). `gram` is the length of anchors.
    """
    if length < 16:
        raise ValueError("windows have 16 bytes or more")
    gram = gram or min(GRAM, length // 2)
    # Without first copies to keep, the order of documents tells nothing.
    placed = docs.select("row", F.col("order") if keep_first else F.lit(0).cast("long").alias("order"), "text")
    row_type, order_type = (placed.schema[c].dataType.simpleString() for c in ("row", "order"))
    found = written(placed.mapInArrow(_anchors(length, gram, 2), f"row {row_type}, order {order_type}, h long, s long, low long, n int"), "spans")
    parts = F.ceil(F.col("c") / PART_SPANS).cast("int") if gram < length else F.lit(1)
    shared = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "c", parts.alias("parts")), "anchors")
    total, most = shared.agg(F.coalesce(F.sum("c"), F.lit(0)), F.max("parts")).first()
    kept = written(met_by_key(found, shared, ["h"], "c", total).drop("c"), "shared")
    remove_written(found)
    remove_written(shared)

    spot = F.struct("order", "row", "low")
    spans = written(kept.groupBy("h", "s").agg(F.min(spot).alias("first"), F.max(spot).alias("final"), F.count(F.lit(1)).alias("c"),
                                               F.min("n").alias("n"), F.min("parts").alias("parts")), "kinds")
    part = F.pmod(F.xxhash64("s"), F.col("parts")).cast("int").alias("part")
    one = lambda at, last: F.struct(F.col(f"{at}.order"), F.col(f"{at}.row"), F.col(f"{at}.low"), F.lit(last).alias("last"))
    wanted = (spans.select("h", "s", "n", "parts", part, F.explode(F.when(F.col("c") > 1, F.array(one("first", False), one("final", True)))
                                                                   .otherwise(F.array(one("first", False)))).alias("x"))
              .groupBy(F.col("x.row").alias("row"))
              .agg(F.collect_list(F.struct("h", "s", "n", "parts", "part", "x.order", "x.low", "x.last")).alias("wanted")))
    cut = docs.select("row", "text").mapInArrow(_packed, f"row {row_type}, packed binary").join(wanted, "row").mapInArrow(
        _cut_spans(length), f"h long, part int, parts int, s long, last boolean, order {order_type}, row {row_type}, low long, raw binary")
    dealt = cut.repartition(partitions(docs.sparkSession), "h", "part").sortWithinPartitions("h", "part", "order", "row", "low", "last", "s")
    solved = written(dealt.mapInArrow(_solve(length, keep_first),
                                      f"h long, s long, last boolean, cut array<int>, crowd struct<order:{order_type},row:{row_type},low:bigint,raw:binary>"), "cuts")
    cuts = solved.where("crowd is null").select("h", "s", "last", "cut")
    if (most or 1) > 1:
        crowded = solved.where("crowd is not null").select(F.struct("h", "s", "last").alias("row"), F.struct("crowd.order", "crowd.row", "crowd.low", "last").alias("order"), F.col("crowd.raw").alias("text"))
        inner = repeats(crowded, length, keep_first, length - (length - gram) // 4)
        cuts = cuts.unionByName(inner.select("row.*", F.expr("flatten(transform(cuts, x -> transform(x.cut, k -> k + cast(x.low as int))))").alias("cut")))
    ranges = cuts.groupBy("h", "s").agg(
        *(F.flatten(F.collect_list(F.when(F.col("last") == last, F.col("cut")))).alias(name) for name, last in (("of_first", False), ("of_last", True))))
    marks = written(spans.join(ranges, ["h", "s"]).select("h", "s", "c", "first", "of_first", "of_last"), "marks")
    own = F.when(spot.eqNullSafe(F.col("first")), F.col("of_first")).otherwise(F.col("of_last")) if keep_first else F.col("of_first")
    met = met_by_key(kept.drop("parts"), marks, ["h", "s"], "c", total)
    return (met.select("row", "low", own.alias("cut")).where("size(cut) > 0")
            .groupBy("row").agg(F.collect_set(F.struct("low", "cut")).alias("cuts")))


def _without_cuts(length: int):
    def made(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())],
                                          names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows, size, ids = [], 0, batch.column("doc_id")
            for n, (packed, cuts) in enumerate(zip(batch.column("packed"), batch.column("cuts"), strict=True), 1):
                raw, kept, at, spans, removed = unpack(packed.as_py()), [], 0, 0, 0
                ranges = sorted((x["low"] + x["cut"][k], x["low"] + x["cut"][k + 1] + length - 1) for x in cuts.as_py() or () for k in range(0, len(x["cut"]), 2))
                end = -1
                for a, b in ranges:
                    if a > end:
                        spans += 1
                        kept.append(raw[at:a])
                        end = a
                    removed += max(0, b - end)
                    end = at = max(end, b)
                kept.append(raw[at:])
                rows.append((len(raw), removed, spans, b"".join(kept)))
                size += len(raw)
                if size > SORTED_BYTES:
                    yield made(ids.slice(n - len(rows), len(rows)), rows)
                    rows, size = [], 0
            yield made(ids.slice(len(ids) - len(rows)), rows)

    return lean(run)


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept holds the remaining bytes.

    One row per input row, in no order. Rows of equal or missing doc_id but
    different texts are different documents. Rows equal in id and text are
    copies of each other, so all their bytes go, but where first copies are
    kept they can't be told apart and each keeps what one would. Null ids are
    the first by order. A null text is empty; texts under `length` bytes stay
    whole; an empty table gives no rows. Other columns are ignored. Rows are
    told apart by a 64-bit hash of id and text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumns({"row": F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"), "order": F.coalesce("doc_id", F.lit(-(1 << 63)))})
    cuts = repeats(rows, length, keep_first)
    packed = rows.select("doc_id", "row", "text").mapInArrow(_packed, "doc_id long, row long, packed binary")
    return packed.join(cuts, "row", "left").select("doc_id", "packed", "cuts").mapInArrow(
        _without_cuts(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes the first copies too, as the query's contract has it."""
    cleaned = remove_repeats(table(spark, sf_dir, "documents"), keep_first=False)
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
#: Byte windows of whole tables are too slow in SQL; the tests use a plain loop.
ORACLE_SQL: dict[str, str] = {}
