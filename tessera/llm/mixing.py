"""Mixing sources to target weights: a time-varying curriculum.

Each source gets a target of words: its weight's share of the budget, at most
``max_repeats`` times its own words, the excess shared again by weight. The
weight that a source has during training changes along a straight line; its
integral is the source's cumulative demand. The words of a source, in the order
of a hash of doc_id, meet that demand one after the other, whole passes first,
so a copy that starts at word c of its source's stream is due where the demand
reaches c: the inverse of a quadratic. Sorting all copies by that position
gives the training order.

Running sums are taken within (source, slice of the hash), so that a source
with a third of all rows is thousands of groups, and one sum per slice is
carried on. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, durable, fresh, numbered, table, words

#: Hex digits of a slice of the hash: 4096 slices of each source.
SLICE_DIGITS = 3
#: Weights by source in code point order, repeating, and the tilt of each over
#: the training time: 0.5 goes from half as much again at the start to half.
WEIGHTS, TILTS = (5, 2, 1), (0.5, 0.0, -0.5)


def _sizes(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return docs.select(
        *keep,
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.size(words(F.col("text").cast("string"), SPACE)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"))


def targets(sources: DataFrame, budget: float, max_repeats: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) with weight, tilt and target.

    The level at which the open sources share what the capped ones leave rises
    until no more source is capped; a round sends three sums to the driver.
    """
    ranked = numbered(sources, [F.col("source").isNull().asc(), F.col("source").asc()], "rank", 0)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("rank") % len(values) + 1).cast("int"))
    ranked = durable(ranked.withColumns({"weight": pick(weights), "cap": F.col("source_size") * max_repeats}))
    total, n = ranked.agg(F.sum("source_size"), F.count(F.lit(1))).first()
    level, capped = 0.0, -1
    while n and total:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        now, used, open_weight = ranked.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if now == capped or not open_weight:
            break
        level, capped = max(level, (budget * total - used) / open_weight), now
    return ranked.select(
        "source", "source_size", pick(TILTS).alias("tilt"),
        F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double")).alias("target"))


def _position(start: Column) -> Column:
    """Where in the training time, 0 to 1, a source's demand reaches a word.

    The weight is target * (1 + tilt * (1 - 2 t)), its integral to t is
    target * ((1 + tilt) t - tilt t^2).
    """
    share, tilt = F.least(start / F.col("target"), F.lit(1.0)), F.col("tilt")
    root = F.sqrt(F.greatest((1 + tilt) * (1 + tilt) - 4 * tilt * share, F.lit(0.0)))
    return 2 * share / (1 + tilt + root)


def curriculum(docs: DataFrame, budget: float = 1.5, max_repeats: int = 2, weights: tuple[int, ...] = WEIGHTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: size, its source's size and target, the words
    taken, and `copies` (pass, words, position) with one entry per pass.

    The last copy that a source takes may be a part of its document. Sources
    are in code point order, null last as a source of its own. Documents
    without words, null texts included, take nothing and have no copies. Equal
    doc_ids take turns as different documents. Further columns are ignored but
    for those in `keep`.
    """
    sized = durable(_sizes(docs, keep).withColumn("slice", F.substring("h", 1, SLICE_DIGITS)))
    slices = durable(sized.groupBy("source", "slice").agg(F.sum("size").alias("n")))
    sources = targets(slices.groupBy("source").agg(F.sum("n").alias("source_size")), budget, max_repeats, weights)
    # At most 4096 slices of a source in a window.
    before = slices.withColumn("before", F.sum("n").over(
        W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))).drop("n")
    plan = before.join(sources, before["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = sized.withColumn("own", F.sum("size").over(
        W.partitionBy("source", "slice").orderBy("h", "doc_id", "size", *keep).rowsBetween(W.unboundedPreceding, -1)))
    both = placed.join(plan.withColumnsRenamed({"source": "s", "slice": "k"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("k"))).drop("s", "k")
    start = F.coalesce("own", F.lit(0)) + F.coalesce("before", F.lit(0))
    whole = F.floor("target").cast("long")

    def copy(k: int) -> Column:
        begin = start + F.col("source_size") * k
        return F.struct(
            F.lit(k).alias("pass"), F.greatest(F.least(whole - begin, F.col("size")), F.lit(0)).cast("long").alias("words"),
            _position(begin).alias("position"))

    copies = F.filter(F.array(*map(copy, range(max_repeats))), lambda c: c["words"] > 0)
    return both.select(*keep, "doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn(
        "taken", F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"]))


def training_order(plan: DataFrame) -> DataFrame:
    """The copies of :func:`curriculum`, range-sorted by training position."""
    return _copies(plan).orderBy("position", "source", "doc_id", "pass")


def _copies(plan: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return plan.select(*keep, "doc_id", "source", "size", F.explode("copies").alias("c")).select(*keep, "doc_id", "source", "size", "c.*")


def mix(docs: DataFrame) -> DataFrame:
    """The documents as often as the curriculum takes them, range-sorted by
    training position. Texts stay whole: the last copy of a source counts if at
    least half of it is taken. Documents without words, null texts included,
    go. Null and repeated doc_ids are documents like any other, null sources
    one source, further columns stay as they are, whatever their names, and an
    empty table gives no rows.

    The plan finds its documents by a hash of all their columns. Rows that are
    equal in all of them stand for each other: each has its own place in the
    plan, and one of them is joined to all these places.
    """
    key, turn, at = (fresh(x, docs) for x in ("row", "pass", "position"))
    keyed = docs.withColumn(key, F.xxhash64(*(x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`")))))
    plan = curriculum(keyed.select("doc_id", "source", "text", F.col(key).alias("__row")), keep=("__row",))
    due = _copies(plan, ("__row",)).where("words * 2 >= size").select(F.col("__row").alias(key), F.col("pass").alias(turn), F.col("position").alias(at))
    return keyed.dropDuplicates([key]).join(due, key).orderBy(at, "doc_id", key, turn).select(docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan, range-sorted by the position of each document's first copy."""
    plan = curriculum(table(spark, sf_dir, "documents"))
    made = plan.select("doc_id", "size", "source_size", "target", "taken", F.get("copies", 0)["position"].alias("first_position"))
    return made.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


QUERIES = {"op6_mixing": op6_mixing}
ORACLE_SQL = {"op6_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS k
  FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][k + 1] AS weight, [0.5, 0.0, -0.5][k + 1]::DOUBLE AS tilt, source_size * 2 AS cap FROM sources),
running AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS cap_before, coalesce(sum(weight) OVER before, 0) AS weight_before,
         sum(weight) OVER () AS all_weight, sum(source_size) OVER () AS total
  FROM weighed
  WINDOW before AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min(l, cap::DOUBLE / weight) AS l
  FROM (SELECT *, (1.5 * total - cap_before) / (all_weight - weight_before) AS l FROM running)
  WHERE cap > weight * l),
goal AS (SELECT source, source_size, tilt, least(weight * l, cap::DOUBLE)::DOUBLE AS target FROM weighed, level),
placed AS (
  SELECT s.*, g.source_size, g.tilt, g.target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
taken AS (
  SELECT *, greatest(least(floor(target)::BIGINT - start, size), 0) AS first_words,
         greatest(least(floor(target)::BIGINT - start - source_size, size), 0) AS second_words,
         least(start / target, 1.0) AS share
  FROM placed)
SELECT doc_id, size, source_size, target, (first_words + second_words)::BIGINT AS taken,
       CASE WHEN first_words > 0 THEN 2 * share / (1 + tilt + sqrt(greatest((1 + tilt) * (1 + tilt) - 4 * tilt * share, 0.0))) END AS first_position
FROM taken"""}
