"""Quality scores by Bradley-Terry ranking.

Preference pairs put a document labelled good above one labelled bad. The
probability that the first wins is the logistic function of the difference of
their scores, and a score is linear in features of the text, so learning is
logistic loss on feature differences (Newton steps with a ridge). The cut is
the score quantile that leaves the labelled rows' share of good documents
above it; it is placed at the threshold of the returned 0-to-1 score.

Learning takes every labelled row, and every pair of a good and a bad one
without naming pairs: a step needs how many rows of either class, and which sum
of features, lie in each narrow bin of the scores, and all pairs of two bins
weigh alike. The sums are taken where the rows are; the cut is found by
narrowing the scores it lies between. Scoring is one pass over all documents.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove_written, table, written

FOLDS, THRESHOLD, RIDGE, SEED = 5, 0.3, 1e-3, 7
#: Bins to a unit of score, the most that meet each other, and those that the cut is narrowed by.
BINS, MOST_BINS, CUT_BINS = 32, 2048, 4096
NEWTON_STEPS, SETTLED = 30, 1e-6
_PRINTED = np.arange(32, 127)
_UPPER, _LOWER, _DIGIT = (np.arange(ord(a), ord(b) + 1) for a, b in ("AZ", "az", "09"))


def features(raw: bytes | None) -> np.ndarray:
    """Shares of bytes and of words; an empty text is all zeros but for its mark."""
    raw = raw or b""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    size, words = max(1, len(raw)), raw.split()
    n = max(1, len(words))
    letters = counts[_UPPER].sum() + counts[_LOWER].sum() + counts[128:].sum()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    most = Counter(words).most_common(1)[0][1] if words else 0
    grams = max(0, len(words) - 2)
    measures = [
        float(not words), min(np.log1p(len(words)), 12), min(len(raw) / n, 40),
        sum(map(eq, words, words[1:])) / n, len(set(words)) / n, most / n,
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / grams if grams else 0.0,
        counts[_UPPER].sum() / max(1, letters), letters / size, counts[_DIGIT].sum() / size,
        (len(lines) - len(set(lines))) / max(1, len(lines)), min(np.log1p(n / max(1, len(lines))), 10),
        min(max(map(len, words), default=0), 200) / 200,
    ]
    return np.concatenate([measures, np.sqrt(counts[_PRINTED] / size), [np.sqrt(counts[128:].sum() / size), np.sqrt(counts[:32].sum() / size)]])


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


#: Rows by bin of the score: bins, [class, bin] counts, [class, bin, feature] sums.
Binned = tuple[np.ndarray, np.ndarray, np.ndarray]


def _merged_bins(a: Binned, b: Binned) -> Binned:
    bins, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    counts, sums = np.zeros((2, len(bins))), np.zeros((2, len(bins), a[2].shape[2]))
    for part, places in ((a, at[: len(a[0])]), (b, at[len(a[0]) :])):
        counts[:, places] += part[1]
        sums[:, places] += part[2]
    return bins, counts, sums


def _coarser(found: Binned) -> Binned:
    bins, first = np.unique(found[0] >> 1, return_index=True)
    return bins, np.add.reduceat(found[1], first, 1), np.add.reduceat(found[2], first, 1)


def _moments(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x), good.sum()], x.sum(0), (x * x).sum(0)])


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def _binned(x: np.ndarray, good: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> Binned:
    z = _standard(x, mean, scale)
    bins, at = np.unique(np.floor(z @ w * BINS).astype(np.int64), return_inverse=True)
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], np.arange(len(bins)))
    kinds = [good[order], ~good[order]]
    return bins, *(np.array([np.add.reduceat(y, first) for y in made]) for made in (
        [k.astype(np.float64) for k in kinds], [z[order] * k[:, None] for k in kinds]))


def _bend(x: np.ndarray, good: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, shift: int, bins: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = _standard(x, mean, scale)
    at = np.searchsorted(bins, np.floor(z @ w * BINS).astype(np.int64) >> shift).clip(0, len(bins) - 1)
    return (z * weights[np.where(good, 0, 1), at][:, None]).T @ z


def _spread(x: np.ndarray, good: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, low: float, high: float) -> np.ndarray:
    """[count, sum, sum of squares, least, greatest] of the scores in each of CUT_BINS steps from low to high."""
    s = _standard(x, mean, scale) @ w
    s = np.sort(s[(s >= low) & (s <= high)])
    at = (np.clip((s - low) / max(high - low, 1e-300), 0, 1) * (CUT_BINS - 1)).astype(np.int64)
    made = np.zeros((5, CUT_BINS))
    made[3], made[4] = np.inf, -np.inf
    bins, first, count = np.unique(at, return_index=True, return_counts=True)
    if len(bins):
        made[:, bins] = count, np.add.reduceat(s, first), np.add.reduceat(s * s, first), s[first], s[first + count - 1]
    return made


def _merged_spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([a[:3] + b[:3], np.minimum(a[3:4], b[3:4]), np.maximum(a[4:], b[4:])])


def _sum(a, b):
    return a + b


def _ranked(total: Callable, width: int) -> Ranker:
    """Learn from all pairs. `total(step, merge, *more)` gives the merged results
    of step(x, good, *more) for parts of the rows, None if there are no rows."""
    got = total(_moments, _sum)
    if got is None:
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0)
    n, ups = got[0], got[1]
    mean = got[2 : width + 2] / n
    scale = np.sqrt(np.maximum(got[width + 2 :] / n - mean * mean, 0)) + 1e-3
    w = np.zeros(width)
    if ups in (0, n):
        return Ranker(mean, scale, w, 0.0 if ups else 1.0, 1.0)
    mean, scale, pairs = np.round(mean, 9), np.round(scale, 9), ups * (n - ups)
    step, before = np.zeros(width), np.inf
    for _ in range(NEWTON_STEPS):
        found, shift = total(_binned, _merged_bins, mean, scale, w), 0
        while len(found[0]) > MOST_BINS:
            found, shift = _coarser(found), shift + 1
        bins, counts, sums = found
        middle = [(x @ w) / np.maximum(c, 1) for c, x in zip(counts, sums, strict=True)]
        d = np.clip(middle[0][:, None] - middle[1], -60, 60)
        many = counts[0][:, None] * counts[1] / pairs
        loss = float((many * np.log1p(np.exp(-d))).sum() + RIDGE / 2 * (w @ w))
        if loss > before + 1e-6 and abs(step).max() > SETTLED:  # too far
            step = step / 2
            w = w - step
            continue
        if abs(step).max() < SETTLED and before < np.inf:
            break
        before, lost = loss, 1 / (1 + np.exp(d))
        turn = lost * (1 - lost) / pairs
        slope = (sums[0].T @ (lost @ counts[1]) - sums[1].T @ (lost.T @ counts[0])) / pairs - RIDGE * w
        across = sums[0].T @ turn @ sums[1]
        weights = np.array([turn @ counts[1], turn.T @ counts[0]])
        bend = total(_bend, _sum, mean, scale, w, shift, bins, weights) - across - across.T + RIDGE * np.eye(width)
        step = np.linalg.solve(bend, slope)
        w = w + step
    w = np.round(w, 9)

    # The cut, between the least of as many scores as there are good rows and the next below.
    low, high, above, below, wanted, deviation = -np.inf, np.inf, np.inf, -np.inf, int(ups), None
    while True:
        bounds = (low, high) if deviation is not None else (-8 * abs(w).sum() - 1, 8 * abs(w).sum() + 1)
        spread = total(_spread, _merged_spread, mean, scale, w, *bounds)
        if deviation is None:
            deviation = np.sqrt(max(0.0, spread[2].sum() / n - (spread[1].sum() / n) ** 2))
        used = np.flatnonzero(spread[0])[::-1]
        reached = np.cumsum(spread[0][used])
        k = min(int(np.searchsorted(reached, wanted)), len(used) - 1)
        at, past = used[k], int(reached[k])
        above = spread[3][used[k - 1]] if k else above
        below = spread[4][used[k + 1]] if k + 1 < len(used) else below
        low, high = spread[3][at], spread[4][at]
        if past <= wanted or low == high:  # tied scores stay together, above
            cut = (low + below) / 2 if below > -np.inf else low
            return Ranker(mean, scale, w, float(cut), float(4 / max(1e-6, deviation)))
        wanted -= past - int(spread[0][at])


def learn(x: np.ndarray, good: np.ndarray, pairs: int | None = None) -> Ranker:
    """From feature rows and their labels, by all pairs, or by so many drawn
    ones. With one class only, every score is at the threshold or above it if
    that class is the good one."""
    width = x.shape[1]
    if pairs is None:
        return _ranked(lambda step, merge, *more: step(x, good, *more) if len(x) else None, width)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(width), np.ones(width))
    w, (ups, downs) = np.zeros(width), (np.flatnonzero(good), np.flatnonzero(~good))
    if not (len(ups) and len(downs)):
        return Ranker(mean, scale, w, 0.0 if len(ups) or not len(x) else 1.0, 1.0)
    z, rng = np.clip((x - mean) / scale, -8, 8), np.random.default_rng(SEED)
    d = z[rng.choice(ups, pairs)] - z[rng.choice(downs, pairs)]
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        slope = d.T @ (1 - p) / len(d) - RIDGE * w
        bend = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(width)
        w = w + np.linalg.solve(bend, slope)
    s = z @ w
    cut = float(np.quantile(s, 1 - good.mean()))
    # Between the two classes nearest the cut, so that ties at it fall on neither side.
    above, below = s[s >= cut], s[s < cut]
    if len(above) and len(below):
        cut = float((above.min() + below.max()) / 2)
    return Ranker(mean, scale, w, cut, float(4 / max(1e-6, s.std())))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()).astype(np.float32).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(rows, pa.binary())], names=["doc_id", "h", "x"])


def _held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _totals(rows: DataFrame, width: int) -> Callable:
    """Sums over rows (x, good) for :func:`_ranked`: one for each task, merged
    in about the square root of as many before the driver merges those."""
    few = max(1, int(rows.rdd.getNumPartitions() ** 0.5))

    def total(step: Callable, merge: Callable, *more):
        def merged(made):
            result = None
            for one in made:
                result = one if result is None else merge(result, one)
            return result

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = ((np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float32).astype(np.float64).reshape(-1, width),
                     batch.column(1).to_numpy(zero_copy_only=False).astype(bool)) for batch in batches if batch.num_rows)
            result = merged(step(x, good, *more) for x, good in read)
            if result is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(result)], pa.binary())], names=["made"])

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            result = merged(pickle.loads(x.as_py()) for batch in batches for x in batch.column(0))
            if result is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(result)], pa.binary())], names=["made"])

        made = rows.mapInArrow(run, "made binary")
        if few > 1:
            made = made.repartition(few).mapInArrow(again, "made binary")
        return merged(pickle.loads(bytes(r.made)) for r in made.collect())

    return total


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Learn from all labels outside the held-out fold. A document labelled
    more than once counts once, as good if any label says so; null labels don't
    count. Of documents that share an id the one of least text hash is taken.
    Features meet the labels, so that texts are not shuffled."""
    known = (labels.where("quality is not null and doc_id is not null").where(~_held_out())
             .groupBy("doc_id").agg((F.max("quality") > 0).alias("good")))
    rows = docs.where("doc_id is not null").where(~_held_out()).select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    made = rows.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(
        _featured, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, h long, x binary")
    learnt = written(made.join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct("h", "x", "good")).alias("r")).select("r.x", "r.good"), "labelled")
    width = len(features(None))
    model = _ranked(_totals(learnt, width), width)
    remove_written(learnt)
    return model


def rank(docs: DataFrame, model: Ranker) -> DataFrame:
    """(doc_id, score): one row per input row, repeated rows and null ids too.

    A null text is an empty one; an empty table gives no rows; other columns
    are ignored. The model, some hundred numbers, travels with the function.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()).astype(np.float32) for t in batch.column(1)], np.float64).reshape(batch.num_rows, len(model.mean))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op2_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = rank(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_quality_ranking": op2_quality_ranking}
#: A learned model has no SQL form; the tests measure held-out accuracy.
ORACLE_SQL: dict[str, str] = {}
