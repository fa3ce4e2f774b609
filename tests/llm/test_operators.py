"""Each operator against a plain loop, on texts with the awkward cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tessera.llm import common, decontaminate, html, licenses, mixing, quality, ranking, shards, simhash, suffixes, tokens

SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{k % 977}é" for k in range(3000))
PASSAGE = " ".join(f"shared{k}" for k in range(70))
TEXTS = [
    None, "", " \n\t ", "one", "Two words", "Under the MIT License, then MIT\nlicense again", LONG, LONG + " tail", LONG, "a " * 300,
    f"before {PASSAGE} after one", f"other start {PASSAGE} and other end", PASSAGE, "x" * 500, "naïve ÄÖ mixed CASE " * 20,
    "licensed under the GNU general public license version 3", "a  b   c \n d   <|endoftext|> e", "the same line\nthe same line\nlast",
] + [" ".join(f"t{(k * j) % 613}" for j in range(60)) for k in range(2, 30)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, h string, m2 string, part string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", [None, "b", "a", "c"][k % 4], 0, "clash", "clash", "clash", "clash") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(t, rx=SPACED):
    return rx.findall((t or "").translate(LOWER))


def test_simhash(spark, docs, empty):
    prints = {}
    for k, t in enumerate(TEXTS):
        w = words(t)
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    up = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and up[a] != up[b]:
                    up[a] = up[b] = min(up[a], up[b])
                    changed = True
    got = by_id(simhash.near_duplicates(docs))
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{prints[k]:016x}", up[k]) for k in prints}
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_dense_group_gives_a_forest():
    rng = np.random.default_rng(1)
    prints = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)))
    found = simhash.block_links(prints, np.arange(len(prints)), prints, np.arange(len(prints)), True, 2)
    assert len(found) == len(prints) - 1


def repeats_by_hand(rows, keep, length=200):
    """(n_bytes, n_removed, n_spans, kept) of each (doc_id, text), by all windows."""
    raws = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    places: dict[bytes, list] = {}
    for i in order:
        for k in range(len(raws[i]) - length + 1):
            places.setdefault(raws[i][k : k + length], []).append((i, k))
    made = []
    for i, r in enumerate(raws):
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            at = places[r[k : k + length]]
            if len(at) > 1 and not (keep and at[0] == (i, k)):
                gone[k : k + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(r, gone, strict=True) if not g)
        made.append((len(r), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), kept))
    return made


@pytest.mark.parametrize("part_spans", [suffixes.PART_SPANS, 2])
@pytest.mark.parametrize("hot_share", [common.HOT_SHARE, 10])
def test_suffixes(docs, empty, monkeypatch, part_spans, hot_share):
    monkeypatch.setattr(suffixes, "PART_SPANS", part_spans)
    monkeypatch.setattr(common, "HOT_SHARE", hot_share)
    for keep in (False, True):
        want = repeats_by_hand(list(enumerate(TEXTS)), keep)
        got = by_id(suffixes.remove_repeats(docs, keep_first=keep))
        for i, w in enumerate(want):
            assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == w, (keep, i)
    assert suffixes.remove_repeats(empty).count() == 0


def test_suffixes_tell_rows_of_equal_or_no_id_apart(spark):
    rows = [(7, "qq " * 5), (7, f"{PASSAGE} of seven"), (8, f"x{PASSAGE}"), (None, f"{LONG[:400]} one"), (None, f"{LONG[:400]} two"), (None, None), (9, "y" * 300), (9, "y" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(zip([k for k, _ in rows], repeats_by_hand(rows, False), strict=True), key=str)
    got = sorted(((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in suffixes.remove_repeats(docs, keep_first=False).collect()), key=str)
    assert got == want
    # Rows equal in id and text keep what one of them would: the first window.
    kept = [bytes(r.kept) for r in suffixes.remove_repeats(docs, keep_first=True).where("doc_id = 9").collect()]
    assert kept == [b"y"] * 2


def test_suffixes_of_texts_over_a_chunk(spark):
    rng = np.random.default_rng(3)
    long = "".join(map(chr, rng.integers(97, 123, (1 << 20) + 700_000).tolist()))
    spot = (1 << 20) - 150
    rows = [(1, long), (2, "before " + long[spot : spot + 900] + " after"), (3, long[:250])]
    got = by_id(suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=False))
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed, got[3].n_removed) == (900 + 250, 2, 900, 250)


def test_longest_factors_in_suffix_order():
    rng, rolling = np.random.default_rng(0), suffixes.Rolling()
    for length in (16, 21, 40):
        text = rng.integers(0, 2, 1500).astype(np.uint8)
        text[-300:] = text[:300]
        starts = np.sort(rng.choice(1500 - length + 1, 1200, replace=False))
        windows = [text[k : k + length].tobytes() for k in starts.tolist()]
        places: dict[bytes, list] = {}
        for i, w in enumerate(windows):
            places.setdefault(w, []).append(i)
        earlier, later = suffixes.factors(text, starts, length, rolling)
        assert earlier.tolist() == [places[w][0] < i for i, w in enumerate(windows)]
        assert later.tolist() == [places[w][-1] > i for i, w in enumerate(windows)]
        order, _ = suffixes.suffix_order(text, starts, length, rolling)
        assert order.tolist() == [i for w in sorted(places) if len(places[w]) > 1 for i in places[w]]


def test_licenses(docs, empty):
    got = by_id(licenses.scan(docs))
    for k, t in enumerate(TEXTS):
        w = words(t, ALNUM)
        base = sorted((i, label) for label, phrase in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        found = sorted((s.start, s.label) for s in got[k].spans if s.base)
        assert (got[k].n_words, found) == (len(w), base)
    assert {s.label for s in got[15].spans} == {"gpl"} and licenses.scan(empty).count() == 0


def test_license_texts_with_changes(spark):
    texts = dict(licenses.TEXTS)
    mit, bsd = texts["mit"], texts["bsd"]
    changed = mit.replace("free of charge", "without any charge").replace("publish", "print")
    lost = " ".join(bsd.split()[:20] + bsd.split()[22:])
    rows = [(1, f"Copyright Someone {mit}"), (2, changed), (3, lost), (4, " ".join(mit.split()[:30])), (5, " ".join(mit.split()[::-1])), (6, mit + " " + texts["isc"])]
    got = {r.doc_id: sorted({s.label for s in r.spans}) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["mit"], 2: ["mit"], 3: ["bsd"], 4: ["mit"], 5: [], 6: ["isc", "mit"]}


def test_decontaminate(spark, docs, empty, monkeypatch):
    items = [(1, PASSAGE), (2, " ".join(f"shared{k}" for k in range(5, 30))), (3, "Two words"), (4, None), (5, ""), (11, LONG), (11, LONG)]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def plain(t):
        w, hit, names = words(t, ALNUM), set(), set()
        for i, x in items:
            v = words(x, ALNUM)
            n = min(13, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    names.add(str(i))
        return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()

    want = {k: plain(t) for k, t in enumerate(TEXTS)}
    for at_once, bad in ((decontaminate.PRINTS_AT_ONCE, decontaminate.BAD_AT_ONCE), (50, 0)):
        monkeypatch.setattr(decontaminate, "PRINTS_AT_ONCE", at_once)
        monkeypatch.setattr(decontaminate, "BAD_AT_ONCE", bad)
        got = by_id(decontaminate.overlaps(docs, bench))
        assert {k: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for k, r in got.items()} == want
        kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
        assert kept == {k for k, (n, h, *_) in want.items() if not (h and 20 * h >= n)}
    assert decontaminate.overlaps(empty, bench).count() == 0
    assert decontaminate.overlaps(docs, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


def test_mixing(docs, empty):
    got = by_id(mixing.curriculum(docs))
    size = {k: len(SPACED.findall(t or "")) for k, t in enumerate(TEXTS)}
    source = {k: [None, "b", "a", "c"][k % 4] for k in size}
    total = Counter()
    for k, s in source.items():
        total[s] += size[k]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight, level_of, open_ = dict(zip(order, [5, 2, 1, 5], strict=True)), {}, set(order)
    left = 1.5 * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * total[s]}
        level_of |= {s: float(2 * total[s]) for s in full} if full else {s: level * weight[s] for s in open_}
        left -= sum(2 * total[s] for s in full)
        open_ = open_ - full if full else set()
    taken = Counter()
    for k, r in got.items():
        assert (r["size"], r.source_size) == (size[k], total[source[k]]) and r.target == pytest.approx(level_of[source[k]]) and r.taken <= 2 * r["size"]
        taken[source[k]] += r.taken
    assert all(abs(taken[s] - level_of[s]) <= 1 for s in order)
    assert {k: r.taken for k, r in by_id(mixing.curriculum(docs.repartition(7))).items()} == {k: r.taken for k, r in got.items()}
    places = [r.position for r in mixing.training_order(mixing.curriculum(docs)).collect()]
    assert places == sorted(places) and mixing.curriculum(empty).count() == 0


def test_quality(docs, empty):
    got = by_id(quality.judge(docs))
    for k, t in enumerate(TEXTS):
        w, lines = SPACED.findall(t or ""), [x for x in (t or "").split("\n") if SPACED.search(x)]
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[k].m[c] for c in quality.OUTPUT) == want
        assert got[k].base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (got[k].base_failed and got[k].kept)
    assert quality.judge(empty).count() == 0


def test_tokens(spark, docs, empty):
    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = by_id(tokens.tokenize(docs))
    for k, t in enumerate(TEXTS):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokens.tokenize(empty).count() == 0


def test_token_files_and_selective_reads(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "tokens")
    tokens.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    for file in (tmp_path / "tokens").glob("*.parquet"):
        found = pq.ParquetFile(file).metadata
        for group in (found.row_group(k) for k in range(found.num_row_groups)):
            columns = {group.column(k).path_in_schema.split(".")[0]: group.column(k) for k in range(group.num_columns)}
            assert "RLE_DICTIONARY" in columns["ids"].encodings and group.total_byte_size <= tokens.LAYOUT["parquet.block.size"] * 1.1
            assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "n_tokens", "start_in_part"))
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    whole = {r.doc_id: (r.start, r.ids) for r in tokens.read_tokens(spark, path).collect()}
    some = tokens.read_tokens(spark, path, "doc_id between 5 and 9")
    assert {r.doc_id: (r.start, r.ids) for r in some.collect()} == {k: whole[k] for k in range(5, 10)}
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,5)" in plan
    sizes = tokens.read_metadata(spark, path)
    assert {r.doc_id: (r.start, r.n_tokens) for r in sizes.collect()} == {k: (s, len(ids)) for k, (s, ids) in whole.items()}
    assert "ids" not in sizes._jdf.queryExecution().executedPlan().toString()


def test_encoder_cuts_only_where_ids_stay(monkeypatch):
    import json
    import random

    import pyarrow as pa

    definition = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    tokenizer, encoder, rng = Tokenizer.from_str(definition), tokens.Encoder(definition), random.Random(4)
    signs = list(" \t\n\r\x0b\x1c\x1f\x85\u3000\u00a0 abcéßØ12.,;'\u2019\"-_<|>中") + ["   ", "'s", "it's ", "<|endoftext|>", "word "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(4000)]
    monkeypatch.setattr(tokens, "PIECES", 500)
    for k in range(0, len(texts), 200):
        ids, counts = encoder.encode(pa.array(texts[k : k + 200]))
        want = [x.ids for x in tokenizer.encode_batch(texts[k : k + 200], add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    made = json.loads(definition)
    for change in ({"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "NFC"}}, {"added_tokens": [{"id": 1, "content": "two words"}]}):
        assert not tokens.cuts_at_spaces(json.dumps(made | change))
    other = json.dumps(made | {"normalizer": {"type": "Lowercase"}})
    ids, _ = tokens.Encoder(other).encode(pa.array(["Some TEXT", ""]))
    assert ids.tolist() == tokenizer.encode("some text").ids


def test_html(spark):
    article = "<article><h1>T &amp; t</h1><p>One<p>two <b>in</b>line<div class='promo-box'>Buy</div>{}<section id=comments><p>me</p></section></article>"
    page = "<html><head><title>x</title><script>var a='</p>'</script></head><body><nav>menu</nav>" + article + "<aside>s</aside><form>f</form><footer>f"
    site = "<div><p>Follow our site</p></div>"
    rows = [(k, f"http://h.example/{k}", page.format(f"<p>text {k}</p>" + site)) for k in range(12)]
    rows += [(20, None, None), (21, "http://h.example/b", ""), (22, "bad url", page.format("<p>lone" + site)), (None, "http://h.example/n", "<p>a<br>b")]
    got = by_id(html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert all(got[k].text == f"T & t\nOne\ntwo inline\ntext {k}" for k in range(12))
    assert got[20].text == got[21].text == "" and got[22].text.endswith("lone\nFollow our site") and got[None].text == "a b"
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_shards(docs, empty):
    got = by_id(shards.shard(docs))
    slots = Counter(r.shard for r in got.values())
    assert max(slots.values()) - min(slots[k] for k in range(16)) <= 1
    assert {(r.shard, r.slot) for r in got.values()} == {(s, k) for s, n in slots.items() for k in range(n)}
    assert all((r["size"], r.text_crc32) == (len((TEXTS[k] or "").encode()) + 1, zlib.crc32((TEXTS[k] or "").encode())) for k, r in got.items())
    assert sorted(shards.permute(np.arange(1000), 1000).tolist()) == list(range(1000)) and shards.shard(empty).count() == 0


def test_ranking_held_out(spark):
    made = ranking.op2_quality_ranking(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in made) >= 0.97 * len(made) and all(0 <= r.score <= 1 for r in made)
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = ranking.train(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert ranking.rank(spark.createDataFrame([(1, None), (None, "x")], "doc_id long, text string"), model).count() == 2


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
