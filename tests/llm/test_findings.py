"""Findings of the second round's review."""

import random
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import nearcopies, ranking, suffixes, tokens


def all_pairs(x, good):
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-3), -8, 8)
    d, w = (z[good][:, None] - z[~good]).reshape(-1, x.shape[1]), np.zeros(x.shape[1])
    for _ in range(20_000):
        w = w + 0.5 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - ranking.RIDGE * w)
    return w


def test_ranking_learns_from_all_pairs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    good = x[:, 0] + 0.5 * x[:, 3] + 0.3 * rng.normal(size=60) > 0.4
    model = ranking.learn(x, good)
    assert np.allclose(model.weights, all_pairs(x, good), atol=2e-3)
    above = model.score(x) >= ranking.THRESHOLD
    assert above.sum() == good.sum() and model.raw(x)[above].min() > model.raw(x)[~above].max()


def test_training_takes_every_labelled_row(spark):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{x}" + "!" * (k % 3) for x in rng.integers(0, 9 + 20 * (k % 2), 30))) for k in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 2 or k < 6)) for k in range(60)], "doc_id long, quality int")
    held = {r.doc_id for r in docs.where(ranking._held_out()).collect()}
    known = [(t, bool(k % 2 or k < 6)) for k, t in rows if k not in held]
    x, good = np.array([ranking.features(t.encode()).astype(np.float32) for t, _ in known], np.float64), np.array([g for _, g in known])
    model, again = ranking.train(docs.repartition(3), labels), ranking.train(docs.repartition(7), labels.repartition(2))
    whole = ranking.learn(x, good)
    assert np.allclose(model.weights, whole.weights, atol=1e-6) and np.isclose(model.cut, whole.cut)
    assert (model.weights == again.weights).all() and model.cut == again.cut
    assert (model.score(x) >= ranking.THRESHOLD).sum() == good.sum()


def grams(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


@pytest.mark.parametrize(("named", "block"), [(64, 512), (4, 512), (4, 9)])
def test_a_large_group_of_less_than_similar_texts_names_no_pairs(spark, monkeypatch, named, block):
    rng = random.Random(4)
    base, texts = [f"b{k}" for k in range(150)], []
    for k in range(300):
        w = list(base)
        for j in range(2):
            w[7 + 70 * j + rng.randrange(60)] = f"own{k}of{j}"
        texts.append(" ".join(w))
        if k % 30 == 0:  # chains of texts that are similar to the one before only
            for j in range(3):
                w[rng.randrange(150)] = f"next{k}of{j}"
                texts.append(" ".join(w))
    found, up = [grams(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(found[a] & found[b]) >= 4 * len(found[a] | found[b]) and up[a] != up[b]:
                up = [up[a] if x == up[b] else x for x in up]
    monkeypatch.setattr(nearcopies, "NAMED_ROWS", named)
    monkeypatch.setattr(nearcopies, "BLOCK_ROWS", block)
    passed, links = [], nearcopies._links
    monkeypatch.setattr(nearcopies, "_links", lambda pairs, texts: passed.append(pairs.count()) or links(pairs, texts))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    linked = {r.node: r.component for r in nearcopies.near_copies(docs).collect()}
    nodes = {r.doc_id: r.node for r in docs.selectExpr("doc_id", "xxhash64(cast(text as binary)) node").collect()}
    got = {}
    for k in range(len(texts)):
        got.setdefault(linked.get(nodes[k], nodes[k]), set()).add(k)
    want = {}
    for k, x in enumerate(up):
        want.setdefault(x, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) < len(texts)
    assert named == 64 or passed[1] < len(texts)


@pytest.mark.parametrize("bits", [nearcopies.MARKED_BITS, 64])
def test_needed_texts_alone_travel(spark, monkeypatch, bits):
    monkeypatch.setattr(nearcopies, "MARKED_BITS", bits)
    texts = spark.range(-500, 500).selectExpr("xxhash64(id) as node", "cast(cast(id as string) as binary) as text")
    for few in (0, 1, 30):
        nodes = texts.orderBy("node").limit(few).select("node")
        made = nearcopies._made_of(texts, nodes, nearcopies._sets, "node long, size int, held binary")
        assert sorted(r.node for r in made.collect()) == sorted(r.node for r in nodes.collect())


@pytest.mark.parametrize("keep_first", [False, True])
def test_spans_of_a_crowded_anchor_make_no_row_for_each_window(spark, monkeypatch, keep_first):
    rng = random.Random(6)
    base, texts = [f"b{k}" for k in range(100)], []
    for k in range(150):
        w = list(base)
        for j in range(2):
            w[rng.randrange(100)] = f"own{rng.randrange(120)}"
        texts.append(" ".join(w))
    places, length = defaultdict(list), 200
    for i, t in enumerate(texts):
        for k in range(len(t) - length + 1):
            places[t[k : k + length]].append((i, k))
    gone = [set() for _ in texts]
    for at in places.values():
        for i, k in at[keep_first:] if len(at) > 1 else []:
            gone[i].update(range(k, k + length))
    made, written = [], suffixes.written

    def counted(df, name):
        table = written(df, name)
        arrays = [f"size({f.name})" for f in table.schema if f.dataType.typeName() == "array"]
        made.append(table.selectExpr(f"coalesce(sum(1 + {' + '.join(f'greatest({x}, 0)' for x in arrays) or '0'}), 0) n").first().n)
        return table

    monkeypatch.setattr(suffixes, "PART_SPANS", 20)
    monkeypatch.setattr(suffixes, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: bytes(r.kept).decode() for r in suffixes.remove_repeats(docs, keep_first=keep_first).collect()}
    assert got == {i: "".join(c for k, c in enumerate(t) if k not in gone[i]) for i, t in enumerate(texts)}
    # No table has nearly the rows and elements that a row for each window would make.
    assert max(made) < len(places) / 4, (made, len(places))


HELD = """
import ctypes
import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

from tessera.llm import suffixes


def anon():
    return int(re.search(r"Pss_Anon: +([0-9]+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def batches():
    rng = np.random.default_rng(1)
    for _ in range(3):
        ids = pa.array(range(10_000), pa.int64())
        yield pa.RecordBatch.from_arrays([ids, ids, pa.array([rng.integers(97, 101, 3000, np.uint8).tobytes() for _ in range(10_000)])], names=["row", "order", "text"])


for made in {"anchors": suffixes._anchors(200, 32, 2), "packed": suffixes._packed}[sys.argv[1]](batches()):
    del made
held = anon()
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
print(held - anon())
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="reads the memory of a process as Linux tells it")
@pytest.mark.parametrize("step", ["anchors", "packed"])
def test_a_worker_of_the_suffix_operator_keeps_no_free_memory(step):
    ran = subprocess.run([sys.executable, "-c", HELD, step], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    assert float(ran.stdout) < 8, "MB that were free and not given back"


class Counted:
    """A tokenizer's model that counts the pieces it is given."""

    def __init__(self, model):
        self.model, self.seen = model, Counter()

    def tokenize(self, piece):
        self.seen[piece] += 1
        return self.model.tokenize(piece)


def token_batches():
    """30 batches: 40 words that are in all of them, and others that come once."""
    rng, common = random.Random(8), [f"{a}{b}{c}" for a in "klmnp" for b in "aeiou" for c in ("ndo", "nßen")][:40]
    return common, [[" " + " ".join(rng.sample(common, 40) + ["".join(rng.choices("abcdefghé", k=12)) for _ in range(60)]) + ", and" for _ in range(3)] for _ in range(30)]


def encoded(batches, check=lambda encoder: None, kind=pa.string()):
    definition = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    tokenizer, encoder = Tokenizer.from_str(definition), tokens.Encoder(definition)
    encoder.model = Counted(encoder.model)
    for texts in batches:
        ids, counts = encoder.encode(pa.array(texts, kind))
        want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        check(encoder)
    return encoder.model.seen


def test_pieces_met_again_are_encoded_once(monkeypatch):
    monkeypatch.setattr(tokens, "PIECES", 500)
    common, batches = token_batches()
    seen = encoded(batches)
    assert len(seen) > 5000 and max(n for p, n in seen.items() if p[1:] in common) == 1


def test_pieces_of_one_hash_keep_their_ids(monkeypatch):
    monkeypatch.setattr(tokens, "WEIGHTS", np.zeros_like(tokens.WEIGHTS), raising=False)
    encoded(token_batches()[1][:4] + [["", "a", "a\0", "\0a", "ab" * 40, "ab" * 40 + "c"]])


def test_texts_of_large_types_have_the_same_ids():
    encoded(token_batches()[1][:4], kind=pa.large_string())


def test_long_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "PIECES", 100)
    rng, most = random.Random(9), []
    batches = [["".join(rng.choices("漢字仮名交", k=2000)) for _ in range(3)] for _ in range(20)]
    encoded(batches, lambda encoder: most.append(len(encoder.ids)))
    assert max(most) < 0.2 * sum(len(t) for texts in batches for t in texts)
