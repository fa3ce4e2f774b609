"""Token-ID output: Parquet list columns in controlled row groups.

Texts are range-partitioned and sorted by doc_id before they are encoded (text
is smaller than its ids, and encoding runs once). A task writes its documents
with their place among the task's own ids; the places in the whole are carried
on from one total per task. Ids are dictionary-encoded, the other columns
delta-encoded, and pages are small and indexed, so a reader that wants the
metadata or a few documents touches only those pages.

Byte-level BPE pieces never reach across a single space between two other
characters, nor from a word to the ASCII sign that follows. Where the tokenizer
is of that kind, Arrow splits a batch of texts there and numbers the different
pieces, each is encoded once, and the ids of the texts are gathered by number;
they are those of the whole texts. A worker remembers pieces for its later
batches, found by a hash and compared in whole; those met again outlast the
others. Another tokenizer encodes whole texts.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, shared_path, table

END_ID = 0
#: Pieces that a worker remembers; beyond this, or IDS ids of each, it keeps
#: the half at most, of pieces of at most IDS ids that were met most often.
PIECES, IDS = 250_000, 16
#: Bytes of a piece that its hash looks at, and their weights and the length's.
HASHED = 64
WEIGHTS = np.random.default_rng(0).integers(1 << 63, size=HASHED + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text encoded at a time.
AT_ONCE = 1 << 20
#: Row groups and pages of the files.
LAYOUT = {
    "parquet.block.size": 32 << 20, "parquet.page.size": 256 << 10, "parquet.page.row.count.limit": 2000,
    "parquet.writer.version": "v2", "parquet.enable.dictionary": "true",
    **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "n_tokens", "part", "start_in_part")},
}
#: A space that isn't alone before the next character, the spaces that texts
#: are cut at, the ends of words before an ASCII sign, and the mark put there.
UNSAFE, CUT = r" (?:[\s\x0b\x1c-\x1f\x{85}\pZ]|\z)", re.compile(r"(?<=\S)(?= \S)")
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
WORD_END, MARK = rf"([{LETTERS}])([!-@\[-`{{-~\n])", "\x1f"
WORD = rf"\A [{LETTERS}]+\z"


def _strings(texts: pa.Array) -> list[str]:
    """As to_pylist, without a scalar of each."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def _hashes(pieces: pa.Array) -> np.ndarray:
    """64 bits of each piece, of its length and its first bytes."""
    if not len(pieces):
        return np.empty(0, np.uint64)
    stops = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
    length = np.diff(stops)
    size = np.minimum(length, HASHED)
    ends = np.cumsum(size)
    place = np.arange(ends[-1]) - np.repeat(ends - size, size)
    found = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[np.repeat(stops[:-1], size) + place]
    sums = np.append(np.uint64(0), np.cumsum((found + np.uint64(1)) * WEIGHTS[place]))
    return sums[ends] - sums[ends - size] + length.astype(np.uint64) * WEIGHTS[HASHED]


def cuts_at_spaces(definition: str) -> bool:
    """Whether pieces may be cut at single spaces and ends of words: byte-level
    BPE with the usual word pattern, no normalizer, and no added token that is
    a word or looks at spaces."""
    made = json.loads(definition)
    model, pre = made["model"], made.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not model.get("dropout") and not made.get("normalizer") and not made.get("truncation")
    usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return plain and usual and not any(
        re.search(r"\s", x["content"]) or re.fullmatch(rf"[{LETTERS}]+", x["content"]) or x.get("lstrip") or x.get("rstrip") or x.get("single_word")
        for x in made.get("added_tokens") or ())


class Encoder:
    """Ids of whole texts. Pieces met before are numbered, a space before a
    word is part of its piece; their ids lie one after the other."""

    def __init__(self, definition: str):
        self.tokenizer, self.cuts = tokenizers.Tokenizer.from_str(definition), cuts_at_spaces(definition)
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        added = [re.escape(x["content"]) for x in json.loads(definition).get("added_tokens") or ()]
        self.unsafe = "|".join([UNSAFE, MARK, *added])
        #: The printable stand-in that a byte-level vocabulary has for each byte.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.signs = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.known, self.ids, self.stops = pa.array([], pa.string()), array("i"), array("i", [0])
        #: The batches that met a piece again; hashes in order, and their pieces.
        self.met, self.hashes, self.order = np.empty(0, np.int32), np.empty(0, np.uint64), np.empty(0, np.int32)

    @classmethod
    def of(cls, definition: str) -> Encoder:
        """One for each worker process; tasks that follow find it again."""
        state = sys.modules.setdefault("tessera_worker_state", ModuleType("tessera_worker_state")).__dict__
        if state.get("definition") != definition:
            state.update(definition=definition, encoder=cls(definition))
        return state["encoder"]

    def _lists(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.array(self.stops, np.int32)), pa.array(np.array(self.ids, np.int32)))

    def _forget(self) -> None:
        half, sizes = PIECES // 2, np.diff(np.array(self.stops, np.int32))
        least = np.partition(self.met, -half)[-half] if len(self.met) > half else 0
        kept = np.flatnonzero((self.met > least) & (sizes <= IDS))
        self.ids, self.stops = array("i", self._lists().take(pa.array(kept)).flatten().to_numpy().tobytes()), array("i", [0, *np.cumsum(sizes[kept]).tolist()])
        self.known, self.met = self.known.take(pa.array(kept)), self.met[kept] // 2
        hashes = _hashes(self.known)
        self.order = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.order]

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of different pieces; those not met before are encoded."""
        number, hashes = np.zeros(len(pieces), np.int32), _hashes(pieces)
        again = np.zeros(len(pieces), bool)
        if len(self.known):
            number = self.order[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)]
            # Pieces that share a hash with another are encoded again.
            again = pc.equal(pieces, self.known.take(pa.array(number))).to_numpy(zero_copy_only=False)
            self.met[number[again]] += 1
        new = np.flatnonzero(~again)
        if len(new):
            # A space and letters are one piece before BPE, so the model alone will do.
            word = pc.match_substring_regex(pieces.take(pa.array(new)), WORD).to_numpy(zero_copy_only=False)
            new, n_words = np.concatenate([new[word], new[~word]]), int(word.sum())
            made = pieces.take(pa.array(new))
            ids, stops, tokenize, number_of, space = self.ids, self.stops, self.model.tokenize, attrgetter("id"), self.signs[32]
            for p in _strings(made.slice(0, n_words)):
                ids.extend(map(number_of, tokenize(space + p[1:] if p.isascii() else p.encode().decode("latin-1").translate(self.signs))))
                stops.append(len(ids))
            rest = _strings(made.slice(n_words))
            for k in range(0, len(rest), 5000):
                for got in self.tokenizer.encode_batch_fast(rest[k : k + 5000], add_special_tokens=False):
                    ids.extend(got.ids)
                    stops.append(len(ids))
            number[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known, self.met = pa.concat_arrays([self.known, made]), np.append(self.met, np.zeros(len(new), np.int32))
            added = new[np.argsort(hashes[new])]
            at = np.searchsorted(self.hashes, hashes[added])
            self.hashes, self.order = np.insert(self.hashes, at, hashes[added]), np.insert(self.order, at, number[added])
        return number

    def _pieces(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """(text, pieces): pieces in the order of the texts, and the number of
        each piece's text. Texts where a cut at every space or mark would be
        wrong are apart."""
        unsafe = pc.match_substring_regex(texts, self.unsafe)
        marked = pc.replace_substring_regex(texts.filter(pc.invert(unsafe)), WORD_END, rf"\1{MARK}\2")
        apart = pa.array([CUT.split(x) for x in texts.filter(unsafe).to_pylist()], pa.list_(pa.string()))
        for flag, lists in ((False, pc.split_pattern(pc.replace_substring(marked, " ", MARK + " "), MARK)), (True, apart)):
            if len(lists):
                yield np.repeat(np.flatnonzero(unsafe.to_numpy(zero_copy_only=False) == flag), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count): the ids of all texts, and how many each has."""
        if not self.cuts:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.int32), np.array([*map(len, found)], np.int64)
        if len(self.known) > PIECES or len(self.ids) > IDS * PIECES:
            self._forget()
        made = []
        for text, pieces in self._pieces(texts.cast(pa.string())):
            coded = pieces.dictionary_encode()
            made.append((text, self._numbers(coded.dictionary)[coded.indices.to_numpy()]))
        text, of = map(np.concatenate, zip(*made, strict=True))
        if len(made) > 1:
            order = np.argsort(text, kind="stable")
            text, of = text[order], of[order]
        lists = self._lists().take(pa.array(of))
        counts = np.diff(lists.offsets.to_numpy())
        return lists.flatten().to_numpy(), np.bincount(text, counts, len(texts)).astype(np.int64)


def _encode(definition: str, end_id: int):
    def groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
        """Rows that are encoded together: AT_ONCE bytes, or one longer text."""
        size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(size, size[low] + AT_ONCE, "right")) - 1)
            yield low, high
            low = high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = Encoder.of(definition), TaskContext.get().partitionId(), 0
        for batch in batches:
            for low, high in groups(batch.column(1)):
                ids, counts = encoder.encode(batch.column(1).slice(low, high - low))
                values, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                stops = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(values.astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), lists, pa.array(counts), pa.array(np.full(len(counts), part, np.int64)), pa.array(start + stops - counts)],
                    names=["doc_id", "ids", "n_tokens", "part", "start_in_part"])
                start += int(stops[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write (doc_id, ids, n_tokens, part, start_in_part) in ascending doc_id.

    Null ids come first, equal ids in the order of their texts, repeated rows
    as often as they are given. A null or empty text is the end id alone; an
    empty table writes files without rows. Other columns are ignored. The
    folder must not exist.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc()]
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), order[0]).sortWithinPartitions(*order)
    encoded = ranged.mapInArrow(_encode(definition, end_id), "doc_id long, ids array<int>, n_tokens long, part long, start_in_part long")
    encoded.write.mode("error").options(**LAYOUT).parquet(path)


def _placed(spark: SparkSession, path: str, where: Column | str | None) -> DataFrame:
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each file that was written, whatever the data's size.
    before = F.broadcast(totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before")))
    kept = files if where is None else files.where(where)
    return kept.join(before, "part").withColumn("start", F.col("before") + F.col("start_in_part"))


def read_tokens(spark: SparkSession, path: str, where: Column | str | None = None) -> DataFrame:
    """(doc_id, start, ids) of the files, `start` counting all ids before.

    A condition on doc_id or n_tokens is pushed to the scan, where row groups
    and, by their index, pages that can't meet it are skipped.
    """
    return _placed(spark, path, where).select("doc_id", "start", "ids")


def read_metadata(spark: SparkSession, path: str, where: Column | str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens) without touching the ids."""
    return _placed(spark, path, where).select("doc_id", "start", "n_tokens")


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the ids as they were read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """Write the documents' ids to the shared folder and digest what is read back."""
    import public_tokenizers

    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_file or public_tokenizers.path("byte_bpe_50k.json"))
    return digests(read_tokens(spark, path))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"))


QUERIES = {"op8_tokens": op8_tokens}
#: A tokenizer has no SQL form; the tests hold the query against whole-text encoding.
ORACLE_SQL: dict[str, str] = {}
