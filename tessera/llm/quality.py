"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a DataFrame expression over the whole text; no user function
runs. Arrays that a lambda looks back into are bound by :func:`_let`, so they
are built once for a row whatever the optimiser does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, fresh, table, words

#: Frequent words of the corpus languages.
STOP_WORDS = tuple(
    "a an and are as at be by for from had has have he here her his in is it not of on only or re that the this to was were with "
    "au avec ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "auf aus das dem den der des die ein eine er für ich im in ist mit nicht sie und von zu "
    "como con de del el en es la las lo los no para por que se su un una y".split())


@dataclass(frozen=True)
class Rule:
    """Reject where numerator / denominator leaves [least, most]."""

    name: str
    numerator: str
    denominator: str
    least: float | None = None
    most: float | None = None


#: Documents pass every rule or go. Ratios of nothing count as zero.
RULES = (
    Rule("symbols a word", "n_symbols", "n_words", most=0.2),
    Rule("stop words", "n_stop", "n_words", least=0.02),
    Rule("shouted words", "n_upper", "n_words", most=0.5),
    Rule("exclamation marks a word", "n_shout", "n_words", most=0.2),
    Rule("mean word length", "word_chars", "n_words", least=2.0, most=14.0),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=0.5),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(ws: Column) -> Column:
    """Words covered by a 3-word window that the text holds twice or more.

    Windows are 64-bit hashes of their three words. Texts whose hashes are all
    different, which are most, end there. Else the hashes are sorted with their
    places, so that one look at the neighbour marks equals; covered words are
    the marked starts and two more each.
    """
    n = F.size(ws) - 2
    grams = F.transform(
        F.arrays_zip(F.slice(ws, 1, n).alias("a"), F.slice(ws, 2, n).alias("b"), F.slice(ws, 3, n).alias("c")),
        lambda x: F.xxhash64(x["a"], x["b"], x["c"]))

    def covered(g: Column) -> Column:
        def marked(p: Column) -> Column:
            twins = F.zip_with(
                F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1),
                lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
            starts = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
            state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
            return F.aggregate(
                starts, state,
                lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(s["end"], i)).cast("long").alias("n"), (i + 3).alias("end")),
                lambda s: s["n"])

        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_let(placed, marked))

    return F.when(F.size(ws) < 4, F.lit(0).cast("long")).otherwise(_let(grams, covered))


def measured(docs: DataFrame, text_col: str = "text", name: str = "m") -> DataFrame:
    """The given columns and every measure, in fields of a new struct column."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def counts(ws: Column) -> Column:
        made = {
            "n_words": F.size(ws), "word_chars": F.length(F.array_join(ws, "")), "n_repeat_words": _repeat_words(ws),
            "n_stop": F.size(F.filter(ws, lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))),
        }
        return F.struct(*(c.cast("long").alias(k) for k, c in made.items()))

    made = {
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")), "n_shout": F.regexp_count(text, F.lit("!")),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}{2,}")),
    }
    line_counts = _let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    of_words, of_lines = fresh("of_words", docs), fresh("of_lines", docs)
    staged = docs.select("*", _let(words(text, SPACE), counts).alias(of_words), line_counts.alias(of_lines))
    fields = [F.col(of_words)[k].alias(k) for k in ("n_words", "word_chars", "n_repeat_words", "n_stop")]
    fields += [F.col(of_lines)[k].alias(k) for k in ("n_lines", "n_dup_lines")]
    fields += [c.cast("long").alias(k) for k, c in made.items()]
    return staged.select("*", F.struct(*fields).alias(name)).drop(of_words, of_lines)


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one condition over the measures."""
    kept = F.lit(True)
    for rule in rules:
        top, base = m[rule.numerator], F.greatest(m[rule.denominator], F.lit(1))
        if rule.least is not None:
            kept &= top >= base * F.lit(rule.least)
        if rule.most is not None:
            kept &= top <= base * F.lit(rule.most)
    return kept


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input rows with `m`, `base_failed` and `kept`.

    Row by row, so repeated rows stay repeated, null ids stay, and an empty
    table gives no rows. A null text is an empty one: no words, base_failed.
    Columns of the input keep their names and values: where one has a name
    that is made here, the new column has underscores before it.
    """
    m, failed, kept = (fresh(x, docs) for x in ("m", "base_failed", "kept"))
    found = F.col(m)
    return measured(docs, text_col, m).select("*", base_failed(found).alias(failed), (~base_failed(found) & verdict(found, rules)).alias(kept))


def keep(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input rows that pass, with their own columns."""
    return judge(docs, text_col, rules).where(F.col(fresh("kept", docs))).select(docs.columns)


OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", *(f"m.{k}" for k in OUTPUT), "base_failed", "kept")


def _sql() -> str:
    limits = [f"{rule.numerator} {sign} greatest({rule.denominator}, 1) * {limit}::DOUBLE"
              for rule in RULES for sign, limit in ((">=", rule.least), ("<=", rule.most)) if limit is not None]
    return rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '!')) AS n_shout,
         len(regexp_extract_all(t, '\p{{Lu}}{{2,}}')) AS n_upper,
         len(list_filter(w, lambda x: list_contains([{', '.join(f"'{w}'" for w in sorted(set(STOP_WORDS)))}], lower(x)))) AS n_stop
  FROM split LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(limits)} AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)"""


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL = {"op7_quality_rules": _sql()}
