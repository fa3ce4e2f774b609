"""The five stages, chained, against plain Python on a small corpus."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import floor

import corpus_pipeline
import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from tessera.llm import mixing, quality

SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = " ".join(f"asked{k} the" for k in range(12))


def corpus():
    rng = random.Random(8)
    stop = "the and of to in is that it for".split()

    def made(n):
        return [rng.choice(stop) if k % 4 == 0 else f"w{rng.randrange(10**6)}" for k in range(n)]

    rows, bases = [], [made(80 + 3 * k) for k in range(24)]
    for k, w in enumerate(bases):
        rows.append((100 + k, " ".join(w), "abc"[k % 3]))
    for k in range(12):
        w = list(bases[k])
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"changed{rng.randrange(10**6)}"
        rows.append((200 + k, " ".join(w) + (" The end." if k % 2 else ""), "abc"[k % 3]))
    rows += [(300, " ".join(bases[20]), "b"), (301, " ".join(bases[20]).upper(), None), (302, "too short", "a"), (303, None, "a"), (304, "", "c")]
    rows += [(305 + k, " ".join(made(60)) + " " + ITEM + " " + " ".join(made(20)), "c") for k in range(3)]
    rows += [(310, " ".join(made(900)) + " " + ITEM, "b"), (311, "the same words again " * 30, "a"), (312, "## $$ %% && the " * 30, "a")]
    rows += [(None, " ".join(made(91)), "a"), (None, " ".join(made(133)), "b"), (100, " ".join(made(77)), "a"), (100, " ".join(made(78)), None)]
    return rows


def passes(text):
    t = text or ""
    w, lines = SPACED.findall(t), [x for x in t.split("\n") if SPACED.search(x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    m = {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len({i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}),
        "n_stop": sum(x.lower() in quality.STOP_WORDS for x in w), "n_upper": len(regex.findall(r"\p{Lu}{2,}", t)), "n_shout": t.count("!"),
    }
    shares = [(m[r.numerator] / max(m[r.denominator], 1), r) for r in quality.RULES]
    return len(w) >= 50 and 2 * m["n_repeat_words"] <= len(w) and all((r.least is None or x >= r.least) and (r.most is None or x <= r.most) for x, r in shares)


def grams_of(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def without_near_copies(rows):
    named, up = [r for r in rows if r[0] is not None], None
    sets, up = [grams_of(r[1]) for r in named], list(range(len(named)))
    for i in range(len(named)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and up[i] != up[j]:
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    groups = {}
    for k, group in enumerate(up):
        groups.setdefault(group, []).append(named[k])
    return [min(g, key=lambda r: r[0]) for g in groups.values()] + [r for r in rows if r[0] is None]


def is_clean(text):
    w, v = (ALNUM.findall(t.lower()) for t in (text or "", ITEM))
    windows = {tuple(v[k : k + 13]) for k in range(len(v) - 12)}
    hit = {p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for p in range(k, k + 13)}
    return not hit or 20 * len(hit) < len(w)


def mixed(rows):
    size = {r: len(SPACED.findall(r[1] or "")) for r in rows}
    total = Counter()
    for r in rows:
        total[r[2]] += size[r]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight, goal, open_, left = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}, {}, set(order), 1.5 * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * total[s]}
        goal |= {s: 2.0 * total[s] for s in full} if full else {s: weight[s] * level for s in open_}
        left -= sum(2 * total[s] for s in full)
        open_ = open_ - full if full else set()
    out = []
    for s in order:
        start = 0
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(str(r[0] if r[0] is not None else "").encode()).hexdigest(), size[r])):
            for turn in range(2):
                words = max(min(floor(goal[s]) - start - turn * total[s], size[r]), 0)
                out += [r] if words and 2 * words >= size[r] else []
            start += size[r]
    return out


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [r for r in rows if passes(r[1])]
    first = without_near_copies(kept)
    clean = [r for r in first if is_clean(r[1])]
    assert len(rows) > len(kept) > len(first) > len(clean)
    taken = sorted(mixed(clean), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(taken) != len(clean) and any(r[0] is None for r in taken)
    tokenizer, want, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    for i, t, _ in taken:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
