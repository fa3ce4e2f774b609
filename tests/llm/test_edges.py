"""Cases that every operator meets: nulls, repeats, ties, long texts, empty tables, clashing names."""

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from tessera.llm import decontaminate, html, licenses, mixing, nearcopies, quality, ranking, registry, shards, simhash, suffixes, tokens

LONG = " ".join(f"long{k % 9973}word" for k in range(110_000))
ROWS = [
    (1, None, None, None), (2, "", "x", "a"), (3, LONG, "x", "a"), (4, LONG, "x", "b"), (5, "some words under the MIT license", None, None),
    (5, "some words under the MIT license", None, None), (5, "other words of that id", "x", "b"), (None, "a text without id", "x", "a"),
    (None, None, "x", None), (None, "a text without id", "y", "a"),
]
#: Names that the operators use within.
NAMES = "m kept base_failed position pass row key number node h s word words fp tile block part copies slice own rank of_words __row __key __node found n_words spans hit size".split()
CALLS = {
    "simhash": lambda d, b: simhash.near_duplicates(d), "ranking": lambda d, b: ranking.rank(d, ranking.learn(np.zeros((0, len(ranking.features(None)))), np.zeros(0, bool))),
    "suffixes": lambda d, b: suffixes.remove_repeats(d, keep_first=False), "licenses": lambda d, b: licenses.scan(d), "decontaminate": decontaminate.overlaps,
    "mixing": lambda d, b: mixing.curriculum(d), "quality": lambda d, b: quality.judge(d), "tokens": lambda d, b: tokens.tokenize(d), "shards": lambda d, b: shards.shard(d),
}


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    return docs.select("*", *(F.lit(7).alias(n) for n in NAMES))


@pytest.mark.parametrize("name", sorted(CALLS))
def test_one_row_for_every_input_row(spark, name):
    bench = spark.createDataFrame([(1, "some words under the MIT"), (None, None)], "item_id long, text string")
    got = Counter(r.doc_id for r in CALLS[name](frame(spark, ROWS), bench).select("doc_id").collect())
    assert got == Counter(r[0] for r in ROWS)
    empty = CALLS[name](frame(spark, []), bench)
    assert empty.count() == 0


def test_stages_keep_columns_of_any_name(spark):
    docs, bench = frame(spark, ROWS), spark.createDataFrame([(1, "words of that")], "item_id long, text string")
    for made in (quality.keep(docs), nearcopies.deduplicate(docs), decontaminate.clean(docs, bench), mixing.mix(docs)):
        assert made.columns == docs.columns
        rows = made.collect()
        assert all(r[n] == 7 for r in rows for n in NAMES) and {r.doc_id for r in rows} <= {r[0] for r in ROWS}
    assert Counter(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == Counter(r[0] for r in ROWS) - Counter([5])
    kept = Counter(r.doc_id for r in nearcopies.deduplicate(docs).collect())
    assert kept == Counter({1: 1, 3: 1, 5: 2, None: 3})


def test_judge_leaves_columns_of_its_names(spark):
    got = quality.judge(frame(spark, ROWS))
    assert {"m", "_m", "kept", "_kept", "base_failed", "_base_failed"} <= set(got.columns)
    assert {(r.m, r.kept, r.base_failed) for r in got.collect()} == {(7, 7, 7)}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    names = sorted(want.columns)
    plain = lambda df: [tuple("" if pd.isna(v) else f"{v:.9g}" if isinstance(v, (int, float, np.number)) else str(v) for v in r) for r in df[names].sort_values("doc_id").itertuples(index=False)]
    assert sorted(got.columns) == names and plain(got) == plain(want)


def test_workers_need_not_have_the_package(tmp_path):
    """The driver runs elsewhere, and only its own path has the package."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
from tessera.llm import decontaminate, html, nearcopies, ranking, shards, simhash, suffixes, tokens
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(k, f"text {{k}} of some words " * (k + 1)) for k in range(8)], "doc_id long, text string")
labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int")
bench = spark.createDataFrame([(1, "text 3 of some")], "item_id long, text string")
pages = spark.createDataFrame([(1, "http://h/", "<p>a")], "page_id long, url string, html string")
made = [ranking.rank(docs, ranking.train(docs, labels)), decontaminate.overlaps(docs, bench), simhash.near_duplicates(docs), suffixes.remove_repeats(docs),
        tokens.tokenize(docs), shards.shard(docs), nearcopies.deduplicate(docs.selectExpr("*", "'a' as source"))]
assert all(x.count() for x in made) and html.main_text(pages).count() == 1
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in run.stdout, run.stderr[-3000:]


# HTML

def by_hand(source):
    """Main text of the driver's pages, whose articles have h1, p, b and br only."""
    import html as entities

    inner = regex.search(r"<article>(.*?)</article>", source, regex.S)[1]
    blocks = (entities.unescape(regex.sub(r"<[^>]*>", "", regex.sub(r"<br\s*/?>", " ", x))) for x in regex.split(r"</?(?:h1|p)>", inner))
    return "\n".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def test_html_of_all_pages_by_hand(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html.op9_html(spark, "/root/testdata/sf0.01").collect()}
    want = {r.page_id: (r.url, by_hand(r.html)) for r in pages.collect()}
    assert got == {k: (url, text, len(text)) for k, (url, text) in want.items()}


PAGE = "<html><body><div class=top><ul><li><a href=/x{k}>Start</a><li><a href=/y{k}>News</a></ul></div><section><p>Story {k} of <b>the</b> day<p>The end.</section><div><div>Our  site</div>Call us</div></body></html>"


@pytest.mark.parametrize("at_once", [html.TEMPLATES_AT_ONCE, 0])
def test_html_template_by_count_alone(spark, monkeypatch, at_once):
    """Menus and notices without a telling name go by their count, with links that differ."""
    monkeypatch.setattr(html, "TEMPLATES_AT_ONCE", at_once)
    rows = [(k, f"http://h.example/{k}", PAGE.replace("{k}", str(k))) for k in range(6)] + [(50, "http://other.example/", PAGE.replace("{k}", "50"))]
    rows += [(60 + k, "http://copies.example/", PAGE.replace("{k}", "one")) for k in range(9)] + [(None, "http://h.example/", PAGE.replace("{k}", "9")), (0, "http://h.example/0", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert not html.NAMED & {"top"}
    got = [(r.page_id, r.text) for r in html.main_text(pages).collect()]
    whole = "Start\nNews\nStory {}\nThe end.\nOur site\nCall us"
    # The last paragraph recurs beside many texts too, outside an article.
    want = [(k, f"Story {k} of the day") for k in (*range(6), 0)] + [(None, "Story 9 of the day"), (50, whole.format("50 of the day"))]
    want += [(60 + k, whole.format("one of the day")) for k in range(9)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_html_articles_keep_what_they_share(spark):
    page = "<article><h1>Title</h1><p>Story {k}.<p>As ever.</p><div><p>Share this</div></article>"
    pages = spark.createDataFrame([(k, "http://h/", page.replace("{k}", str(k))) for k in range(7)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.main_text(pages).collect()} == {k: f"Title\nStory {k}.\nAs ever." for k in range(7)}
    assert html.main_text(pages.limit(0)).count() == 0


def test_html_deep_pages_take_linear_time():
    import time

    took = []
    for n in (2_000, 20_000):
        began = time.process_time()
        page = html.Page("<div>x" * n + "</span></ul><p>y" * n)
        html.assembled(page.levels, page.texts, page.parts, {c for c, *_ in page.parts})
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.02)


# Ranking and sharding

def test_ranking_by_a_plain_loop():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    good = x[:, 0] + 0.5 * x[:, 3] + 0.3 * rng.normal(size=60) > 0.4
    model = ranking.learn(x, good, pairs=400)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-3), -8, 8)
    draw = np.random.default_rng(ranking.SEED)
    d = z[draw.choice(np.flatnonzero(good), 400)] - z[draw.choice(np.flatnonzero(~good), 400)]
    w = np.zeros(5)
    for _ in range(20_000):  # plain gradient steps to the same optimum
        w = w + 0.5 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - ranking.RIDGE * w)
    assert np.allclose(model.weights, w, rtol=2e-3, atol=2e-3)
    s = z @ model.weights
    assert np.allclose(model.raw(x), s)
    above = model.score(x) >= ranking.THRESHOLD
    assert abs(int(above.sum()) - int(good.sum())) <= 1 and s[above].min() > s[~above].max()
    assert (np.argsort(model.score(x)) == np.argsort(s)).all() or len(set(model.score(x))) < 60
    for one in (True, False):
        alone = ranking.learn(x, np.full(60, one), pairs=10)
        assert ((alone.score(x) >= ranking.THRESHOLD) == one).all()


def test_tied_documents_score_alike(spark):
    docs = spark.createDataFrame([(k, "the same text") for k in range(4)] + [(9, None)], "doc_id long, text string")
    model = ranking.train(docs, spark.createDataFrame([(k, k % 2) for k in range(4)] + [(0, None), (1, 0)], "doc_id long, quality int"))
    assert len({r.score for r in ranking.rank(docs, model).where("doc_id < 4").collect()}) == 1


def test_permutation_by_plain_integers():
    def network(x, bits):
        left, right = x >> bits, x & (1 << bits) - 1
        for key in shards.ROUND_KEYS:
            left, right = right, left ^ ((((right + key) * shards.MULTIPLIER) & 0xFFFFFFFFFF) >> 13 & (1 << bits) - 1)
        return left << bits | right

    for n in (1, 2, 5, 64, 1000, 4097):
        bits, want = shards.half_bits(n), []
        assert 4 ** (bits - 1) < n <= 4**bits or n <= 4
        for x in range(n):
            x = network(x, bits)
            while x >= n:
                x = network(x, bits)
            want.append(x)
        assert shards.permute(np.arange(n), n).tolist() == want and sorted(want) == list(range(n))


def test_shards_by_plain_python(spark):
    import zlib

    rows = [(k * 7 % 41, f"text {k}") for k in range(41)] + [(None, None), (None, "no id"), (3, "again"), (3, "again")]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len(r[1] or "")))
    places = shards.permute(np.arange(len(rows)), len(rows)).tolist()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), p % 16, p // 16) for (i, t), p in zip(order, places, strict=True)]
    got = [tuple(r) for r in shards.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_tokens_of_a_long_text(spark):
    import zlib

    from tokenizers import Tokenizer

    ids = np.array([*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(LONG).ids, 0], "<u4")
    got = tokens.tokenize(spark.createDataFrame([(1, LONG), (2, LONG)], "doc_id long, text string")).collect()
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in got) == [(k * len(ids), len(ids), zlib.crc32(ids.tobytes())) for k in range(2)]
