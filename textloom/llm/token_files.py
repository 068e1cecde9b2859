"""Token ids in ORC files: written in ascending doc_id order, read back stripe by stripe.

Texts are range-partitioned and sorted by doc_id, encoded with the tokenizers library, and written with integer run-length encoding,
a row index, and Bloom filters on doc_id, so that a lookup by doc_id reads only stripes that may hold it. Offsets are
distributed running sums over what is read back.

Cases: null and empty texts have the end id only. A null doc_id comes last. Rows that repeat a doc_id are ordered by length and checksum. Empty tables
write no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_dir, ranges, remove_dir, running_sum, small_batches, table

END_ID = 2
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.rows.between.memory.checks": "500", "orc.compress": "ZSTD"}
#: Bytes of a stripe.
STRIPE = 16 << 20
#: Bytes of texts that are encoded together.
TOGETHER = 8 << 20


class Encoder:
    """Whole texts through a tokenizer of the tokenizers library whose pre-tokens never span white space.

    Texts are split into words and their distinct words counted out in Arrow; what a worker does not remember goes through the library together, as
    lower-case pre-tokens in one text, split by white space only; the ids that end a word tell them apart. For these the file's normaliser is left out (texts are lower-case already)
    and its pre-tokeniser's pattern is replaced by the same pattern here, word by word; merges and ids are always the library's. Texts with signs that the library would
    lower-case, compose or split in ways that depend on more than Latin letters go through the unchanged tokenizer, and so do all texts where the file is of another kind.
    """

    #: Words that are remembered (those of the last batch stay when there are more), and pre-tokens that go through the library in one text.
    REMEMBERED, TOGETHER = 500_000, 1_000
    ODD = "<\\||[^\t\n\r -~\u00a1-\u00ac\u00ae-\u00ff\u0152\u0153]"

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        given = json.loads(model)
        steps = (given.get("pre_tokenizer") or {}).get("pretokenizers", [])
        normal = [x["type"] for x in (given.get("normalizer") or {}).get("normalizers", [])]
        suffix = given["model"].get("end_of_word_suffix")
        #: Only a tokenizer of the known kind is taken apart: lower case, one pattern, bytes, ends of words marked.
        self.pieces = None
        if normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and suffix:
            self.pieces = regex.compile(steps[0]["pattern"]["Regex"]).findall
            lean = given | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, steps[1]]}}
            self.lean = Tokenizer.from_str(json.dumps(lean))
            vocabulary = given["model"]["vocab"]
            self.ends = np.zeros(1 + max(vocabulary.values()), dtype=bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        #: The words remembered, the ids of all, one after the other, and how many each has.
        self.words, self.flat, self.sizes = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def whole(self, texts: list[str]) -> list[tuple[int, ...]]:
        return [tuple(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lower-case words, one after the other, and how many each has."""
        find = self.pieces
        # A word of letters is one pre-token, and one with a sign after it mostly two; other words go through the pattern.
        parts = [(w,) if w.isalpha() else (w[:-1], w[-1]) if w[-1:] in ".," and w[:-1].isalpha() else find(w) for w in words]
        wanted = list(dict.fromkeys(chain.from_iterable(parts)))
        ids, ends, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        for i in range(0, len(wanted), self.TOGETHER):
            own = np.array(self.lean.encode_batch_fast([" ".join(wanted[i : i + self.TOGETHER])], add_special_tokens=False)[0].ids, dtype=np.int32)
            ids.append(own)
            ends.append(np.nonzero(self.ends[own])[0] + 1 + at)
            at += len(own)
        ids, ends = np.concatenate(ids), np.concatenate(ends)
        if len(ends) != len(wanted):
            raise ValueError("the tokenizer does not mark the ends of words")
        of = dict(zip(wanted, range(len(wanted)), strict=True))
        piece = np.fromiter(map(of.__getitem__, chain.from_iterable(parts)), dtype=np.int32)
        size = np.diff(ends, prepend=0)
        before = np.concatenate([[0], np.cumsum(size[piece])])
        last = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
        return ids[ranges((ends - size)[piece], size[piece])], np.diff(before[last], prepend=0).astype(np.int32)

    def _simple(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without odd signs, one after the other, and how many each has."""
        split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        coded = split.flatten().dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        del split, coded
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().copy()
        new = at < 0
        if new.any():
            fresh = words.filter(pa.array(new))
            flat, sizes = self._learn(fresh.to_pylist())
            if len(self.words) + len(fresh) > self.REMEMBERED:
                old = at[~new]
                starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
                self.flat, self.words, self.sizes = self.flat[ranges(starts[old], self.sizes[old])], words.filter(pa.array(~new)), self.sizes[old]
                at[~new] = np.arange(len(old))
            at[new] = np.arange(len(fresh)) + len(self.words)
            self.words, self.flat, self.sizes = pa.concat_arrays([self.words, fresh]), np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        starts = (np.cumsum(self.sizes, dtype=np.int64) - self.sizes)[at]
        sizes = self.sizes[at]
        n = sizes[index]
        before = np.concatenate([np.zeros(1, np.int32), np.cumsum(n, dtype=np.int32)])  # an array's offsets are 32 bits, and so are its values' numbers
        return self.flat[ranges(starts[index].astype(np.int32), n)], np.diff(before[offsets])

    def __call__(self, texts: pa.Array, end: int | None) -> pa.ListArray:
        """The ids of each text, with `end` after them. No text is null."""
        odd = np.ones(len(texts), dtype=bool) if self.pieces is None else pc.match_substring_regex(texts, self.ODD).to_numpy(zero_copy_only=False)
        flat, sizes = self._simple(texts.filter(pa.array(~odd)))
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[~odd] = sizes
        whole = self.whole(texts.filter(pa.array(odd)).to_pylist()) if odd.any() else []
        counts[odd] = [len(x) for x in whole]
        more = 0 if end is None else 1
        offsets = np.concatenate([[0], np.cumsum(counts + more)])
        out = np.full(offsets[-1], 0 if end is None else end, dtype=np.int32)
        kind = np.repeat(odd, counts + more)
        body = np.ones(len(out), dtype=bool)
        if more:
            body[offsets[1:] - 1] = False
        out[body & ~kind] = flat
        out[body & kind] = np.fromiter(chain.from_iterable(whole), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))


def encode(docs: DataFrame, tokenizer_path: str, end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, ids array<int>) for each row, by the tokenizer file at tokenizer_path (on the driver), with end_id after each."""
    with open(tokenizer_path, encoding="utf-8") as f:
        given = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(given.value)

        def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            texts = t.column(1).chunk(0)
            return pa.RecordBatch.from_arrays([t.column(0).chunk(0), encoder(texts, end_id)], ["doc_id", "ids"])

        gc.disable()  # a million small tuples, and no cycles among them
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size >= TOGETHER:
                yield out(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
        if held:
            yield out(held)
        gc.enable()

    small_batches(docs.sparkSession, 128)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


@functools.lru_cache(maxsize=2)
def _encoder(model: str) -> Encoder:
    """The encoder that a worker keeps from task to task."""
    return Encoder(model)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = END_ID, stripe_bytes: int = STRIPE) -> None:
    """Writes each row's ids to ORC files in the folder path, in ascending doc_id order over the files in the order of their names."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    last = F.col("doc_id").isNull()
    ordered = own.repartitionByRange(last, "doc_id", F.xxhash64("text")).sortWithinPartitions(last, "doc_id")
    encode(ordered, tokenizer_path, end_id).write.options(**ORC_OPTIONS, **{"orc.stripe.size": str(stripe_bytes)}).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of the files in the folder path."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def with_checksums(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32) for each row of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1)
            flat = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), dtype="<u4")
            ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], ends[:-1]])
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "n_tokens", "ids_crc32"])

    small_batches(encoded.sparkSession, 128)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_dir(spark, "orc")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    rows = cut(with_checksums(read(spark, path)))
    remove_dir(spark, path)
    return running_sum(rows, ["doc_id", "n_tokens", "ids_crc32"], "n_tokens", "start").select("doc_id", "start", "n_tokens", "ids_crc32")
