"""Stages of the pipeline on near copies, null and repeated ids."""

import random

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


@pytest.mark.parametrize("block", [512, 7])
def test_near_copies_of_08_go(spark, monkeypatch, block):
    from tessera.llm import nearcopies

    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", block)
    rng = random.Random(5)
    texts = [None, "", "three words here", "Three  words here", "three words there"]
    for group in range(12):
        base = [f"g{group}w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(base))
        for k in range(12):
            w = list(base)
            for _ in range(k % 7):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(w + [f"tail{k}"] * (k % 3)))
    up = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= 0.8 and up[a] != up[b]:
                low, high = sorted((up[a], up[b]))
                up = [low if x == high else x for x in up]
    rows = [(k, t, "en", "a", 0) for k, t in enumerate(texts)]
    rows += [(None, texts[5], "en", "a", 0)] * 2 + [(7, "another text under an id given before", "en", "a", 0), (5, texts[5], "en", "a", 0)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    want = [(k, texts[k]) for k in set(up)] + [(None, texts[5])] * 2 + [(7, "another text under an id given before")]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(want, key=key)


def test_passes_and_hot_windows_change_no_rows(spark, monkeypatch):
    from tessera.llm import decontaminate

    dirty, other = (" ".join(f"{x}{k}" for k in range(20)) for x in ("asked", "more"))
    bench = spark.createDataFrame([(1, dirty), (2, other)], "item_id long, text string")
    texts = [(None, dirty), (None, "clean text without id"), (None, None), (1, dirty), (1, "clean under the id of another"), (2, "twice"), (2, "twice"), (3, f"{dirty} {other}")]
    docs = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in texts], SCHEMA).repartition(3)
    found = {}
    for size, hot in ((decontaminate.PRINTS_AT_ONCE, decontaminate.HOT_SHARE), (3, 10**9)):
        monkeypatch.setattr(decontaminate, "PRINTS_AT_ONCE", size)
        monkeypatch.setattr(decontaminate, "BAD_AT_ONCE", size // 4)
        monkeypatch.setattr(decontaminate, "HOT_SHARE", hot)
        judged = sorted(map(str, decontaminate.overlaps(docs, bench).collect()))
        kept = sorted(map(str, decontaminate.clean(docs, bench).select("doc_id", "text").collect()))
        found[size] = judged, kept
        assert len(judged) == len(texts)
        assert kept == sorted(f"Row(doc_id={k}, text={t!r})" for k, t in texts if dirty not in (t or ""))
    assert len(found) == 2 and len(set(map(str, found.values()))) == 1


def test_mix_takes_null_and_repeated_ids_as_planned(spark):
    from collections import Counter

    from tessera.llm import mixing

    rows = [(k, f"text {k} " * (3 + k % 5), "en", "abc"[k % 3], 0) for k in range(40)]
    rows += [(None, f"no id {k} word", "en", "abc"[k % 3], 0) for k in range(9)] + [(None, "no id 0 word", None, "a", 0)]
    rows += [(3, f"other text {k} under id 3", "en", "abc"[k % 3], 0) for k in range(6)] + [(4, "the same row", "en", "b", 0)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in mixing.mix(docs).collect())
    want = Counter()
    for r in mixing.curriculum(docs).collect():
        want[r.doc_id, r.source, r["size"]] += sum(c["words"] * 2 >= r["size"] for c in r.copies)
    assert got == +want and sum(n for (k, *_), n in want.items() if k is None) > 0
    texts = Counter((r.doc_id, r.text, r.lang) for r in mixing.mix(docs).collect())
    given = Counter(x[:3] for x in rows)
    assert all(n <= 2 * given[k] for k, n in texts.items())
