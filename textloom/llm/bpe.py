"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a token as a whole is resolved by one probe and one comparison.
Tier two takes the misses: bytes in a doubly linked list, and a heap of the pairs that may merge, by rank and place. The rank file is
broadcast, and each worker builds its tables once. A worker remembers a bounded number of the pre-tokens that it resolved last.

Cases: null and empty texts have no tokens. Repeated rows stay. Empty tables give no rows. Extra columns are ignored. A text of any length
is held by one task at a time, with its tokens; a single pre-token of n bytes takes n log n steps.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranges, small_batches, table

#: Stretches whose ids a worker remembers, and pre-tokens in each of two generations.
REMEMBERED, PIECES = 500_000, 100_000


#: A space at an end or beside other white space.
ODD_SPACE = "^ | $" + "".join(f"| {c}|{c} " for c in ["[\\t-\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"])
#: Bytes of texts that are encoded together.
TOGETHER = 4 << 20
#: An id that no token has: of a place that has merged into another, and of those beyond the ends.
NONE = (1 << 20) - 1


class PerfectHash:
    """Minimal perfect hash by compress-hash-displace: n keys in n slots, one displacement for each bucket of about three keys."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        hashes = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), dtype=np.uint64, count=n)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        shift = np.zeros(self.buckets, dtype=np.int64)
        slot_of = np.zeros(n, dtype=np.int64)
        free = np.ones(n, dtype=bool)
        sizes = np.diff(edges)
        open_slots: list[int] | None = None
        for b in np.argsort(-sizes, kind="stable").tolist():
            members = order[edges[b] : edges[b + 1]]
            if not len(members):
                break
            if len(members) == 1:  # a single key takes any open slot; its displacement is that slot, marked by its sign
                if open_slots is None:
                    open_slots = np.nonzero(free)[0].tolist()
                s = open_slots.pop()
                shift[b], slot_of[members[0]] = -s - 1, s
                continue
            own = [int(h) for h in hashes[members]]
            d = 0
            while True:
                slots = [self._slot(h, d) for h in own]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
            shift[b] = d
            for m, s in zip(members.tolist(), slots, strict=True):
                slot_of[m] = s
                free[s] = False
        self.shift = shift.tolist()
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        for k, v, s in zip(keys, values, slot_of.tolist(), strict=True):
            self.keys[s], self.values[s] = k, v

    def _slot(self, h: int, d: int) -> int:
        h = ((h ^ (h >> 31)) + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        return ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 >> 7 & 0xFFFFFFFFFFFF) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else None


class Codec:
    """Encodes and decodes with the ranks of a rank file and a pattern that finds the pre-tokens."""

    def __init__(self, ranks: bytes, pattern: str):
        """ranks: the lines of a rank file, each a token in base 64 and its rank."""
        pairs = [(base64.b64decode(x.split()[0]), int(x.split()[1])) for x in ranks.splitlines() if x.strip()]
        if any(r >= NONE for _, r in pairs):
            raise ValueError("ids are too large")
        self.table = PerfectHash([t for t, _ in pairs], [r for _, r in pairs])
        rank_of = dict(pairs)
        self.byte_id = [rank_of.get(bytes([b]), -1) for b in range(256)]
        if -1 in self.byte_id:
            raise ValueError("the vocabulary lacks a byte")
        #: What two neighbours merge to, by their ids.
        self.pairs = {a << 20 | b: r for t, r in pairs for i in range(1, len(t)) if (a := rank_of.get(t[:i])) is not None and (b := rank_of.get(t[i:])) is not None}
        self.bytes_of = [b""] * (1 + max((r for _, r in pairs), default=-1))
        for t, r in pairs:
            self.bytes_of[r] = t
        #: Each id in decimal with a space, and each token.
        self.decimal, self.tokens = pa.array([f"{r} " for r in range(len(self.bytes_of))], pa.string()), pa.array(self.bytes_of, pa.binary())
        self.pattern, self.find = pattern, None
        #: The stretches remembered, the ids of all, one after the other, and how many each has.
        self.words, self.flat, self.sizes = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of a pre-token that is not in the vocabulary: the pair of the lowest rank merges first, the leftmost of equals."""
        ids = list(map(self.byte_id.__getitem__, piece))
        n, pair = len(ids), self.pairs.get
        bits = n.bit_length()
        low = (1 << bits) - 1
        # Linked neighbours, with one place more at each end whose id no pair has.
        nxt, prv = list(range(1, n + 2)), list(range(-1, n))
        ids += (NONE, NONE)
        heap = [r << bits | i for i, r in enumerate([pair(a << 20 | b) for a, b in zip(ids[: n - 1], ids[1:n], strict=True)]) if r is not None]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i, rank = x & low, x >> bits
            j = nxt[i]
            if pair(ids[i] << 20 | ids[j]) != rank:  # one of the two has merged meanwhile
                continue
            ids[i], ids[j] = rank, NONE
            k = nxt[i] = nxt[j]
            prv[k] = i
            if (r := pair(rank << 20 | ids[k])) is not None:
                heappush(heap, r << bits | i)
            h = prv[i]
            if (r := pair(ids[h] << 20 | rank)) is not None:
                heappush(heap, r << bits | h)
        return tuple([x for x in ids if x != NONE])

    def resolve(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        one = self.table.get(raw)
        return (one,) if one is not None else self.merge(raw)

    def encode(self, text: str) -> list[int]:
        """The ids of a text. Two generations of remembered pre-tokens: the older is forgotten when the younger is full."""
        if self.find is None:
            self.find, self.young, self.old = regex.compile(self.pattern).findall, {}, {}
        young, old = self.young, self.old
        pieces = self.find(text)
        for piece in {p for p in pieces if p not in young}:
            young[piece] = old.get(piece) or self.resolve(piece)
        ids = list(chain.from_iterable(map(young.__getitem__, pieces)))
        if len(young) > PIECES:
            self.young, self.old = {}, young
        return ids

    def encode_all(self, texts: pa.Array, by_space: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none null), one after the other, and where each text's begin and end.

        by_space says of the pattern that, where every space has a sign that is no white space on both sides, a pre-token holds a space as its first sign only. Then
        the distinct stretches from space to space are counted out in Arrow and resolved once. Texts with other spaces, and all texts under other patterns, go whole.
        """
        if self.find is None:
            self.encode("")
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False) if by_space else np.ones(len(texts), dtype=bool)
        whole = [self.encode(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        coded = split.flatten().dictionary_encode()
        index, plain = coded.indices.to_numpy().astype(np.int32), coded.dictionary
        offsets = split.offsets.to_numpy() - (split.offsets[0].as_py() if len(split) else 0)
        words = pc.binary_join_element_wise(pa.scalar(" "), plain, "")
        if len(index):  # the first stretch of a text has no space before it
            heads = offsets[:-1]
            first, at = np.unique(index[heads], return_inverse=True)
            index[heads] = len(words) + at
            words = pa.concat_arrays([words, plain.take(pa.array(first))])
        del split, coded, plain
        starts, sizes = self._known(words)
        n = sizes[index]
        before = np.concatenate([np.zeros(1, np.int32), np.cumsum(n, dtype=np.int32)])
        ids = self.flat[ranges(starts[index], n)]
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[~odd] = np.diff(before[offsets]) if len(offsets) > 1 else 0
        counts[odd] = [len(x) for x in whole]
        ends = np.concatenate([[0], np.cumsum(counts)])
        out, kind = np.zeros(ends[-1], dtype=np.int32), np.repeat(odd, counts)
        out[~kind] = ids
        out[kind] = np.fromiter(chain.from_iterable(whole), dtype=np.int32)
        return out, ends

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each stretch begin in self.flat, and how many there are; new stretches are resolved. When too many are remembered, those of this batch stay."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().copy()
        new = at < 0
        if new.any():
            fresh = words.filter(pa.array(new))
            each = [tuple(chain.from_iterable(map(self._piece, self.find(w)))) for w in fresh.to_pylist()]
            if len(self.young) > PIECES:
                self.young, self.old = {}, self.young
            sizes = np.fromiter(map(len, each), dtype=np.int32, count=len(each))
            flat = np.fromiter(chain.from_iterable(each), dtype=np.int32, count=int(sizes.sum()))
            if len(self.words) + len(fresh) > REMEMBERED:
                old = at[~new]
                starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
                self.flat, self.words, self.sizes = self.flat[ranges(starts[old], self.sizes[old])], words.filter(pa.array(~new)), self.sizes[old]
                at[~new] = np.arange(len(old))
            at[new] = np.arange(len(fresh)) + len(self.words)
            self.words, self.flat, self.sizes = pa.concat_arrays([self.words, fresh]), np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        return (np.cumsum(self.sizes, dtype=np.int64) - self.sizes)[at], self.sizes[at]

    def _piece(self, piece: str) -> tuple[int, ...]:
        got = self.young.get(piece)
        if got is None:
            got = self.young[piece] = self.old.get(piece) or self.resolve(piece)
        return got

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def _codec(ranks: bytes, pattern: str) -> Codec:
    """The codec that a worker keeps from task to task."""
    return Codec(ranks, pattern)


def _shared(spark: SparkSession, path: str):
    """The bytes of a rank file, which bound what is broadcast."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) for each row of docs, by the rank file at path (on the driver)."""
    ranks = _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _codec(ranks.value, pattern).encode
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc(x.as_py() or "") for x in b.column(1)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    small_batches(docs.sparkSession, 128)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str = "") -> DataFrame:
    """(doc_id, raw binary) for each row of encoded (doc_id, ids); null ids give empty bytes."""
    ranks = _shared(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x.as_py() or []) for x in b.column(1)], pa.binary())], ["doc_id", "raw"])

    small_batches(encoded.sparkSession, 128)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def round_trip(docs: DataFrame, path: str, pattern: str, by_space: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() and decode() in one pass, and digests of what they return. by_space: see Codec.encode_all()."""
    ranks = _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        gc.disable()  # many small tuples, and no cycles among them

        def digests(strings: pa.Array, ids: pa.Array, ends: list[int], less: int) -> pa.Array:
            """Digests of the strings of each text's ids, one after the other, without the last `less` bytes."""
            all_ = strings.take(ids)
            at, raw = np.frombuffer(all_.buffers()[1], dtype=np.int32)[ends].tolist(), memoryview(all_.buffers()[2] or b"")
            return pa.array([hashlib.sha256(raw[i : max(i, j - less)]).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)], pa.string())

        def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, ends = codec.encode_all(t.column(1).chunk(0), by_space)
            ids = pa.array(ids)
            return pa.RecordBatch.from_arrays([t.column(0).chunk(0), pa.array(np.diff(ends), pa.int64()), digests(codec.decimal, ids, ends, 1), digests(codec.tokens, ids, ends, 0)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

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
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_round_trip(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, by_space=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return default_round_trip(table(spark, sf_dir, "documents"))
