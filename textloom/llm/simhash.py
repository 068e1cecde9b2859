"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits, cut into three segments. Of two fingerprints that differ in at most four bits, one segment differs
in at most one, so both have the same variant of that segment with that bit left out. Each fingerprint is indexed under its 64
one-wildcard variants; equality joins on a variant find the candidates, and the join's own condition verifies the distance and
keeps a pair at one variant only. Copies share a fingerprint and are one node. A variant that many fingerprints share is cut into blocks: every
pair of blocks is compared by itself and yields a spanning forest, so neither memory nor the rows made grow with the square.

Cases: null and empty texts and texts of white space have fingerprint zero and link like any other. Repeated rows stay, each with the
same result. A null doc_id never names a component; a component without any doc_id has component_id null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, hashes_of, salt_of, small_batches, table, with_key_min

SHINGLE = 4
MAX_BITS = 4
#: (lowest bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints under one variant up to which they are joined pair by pair, and the size of a block beyond that.
CROWD, BLOCK = 256, 512


def simhash(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit integer."""
    words = (raw or b"").lower().split()  # bytes: lower() changes A-Z only, split() knows ASCII white space only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = np.array([digest(joined, 42)], dtype="<u8")
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        m = n - shingle + 1
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:m].tolist(), ends[shingle - 1 :].tolist(), strict=True)), dtype="<u8", count=m)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) for each row of docs, with the columns (long) to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([simhash(x.as_py(), shingle) for x in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps, *b.columns[2:]], ["doc_id", "fp", *keep])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"), *keep).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *keep)))


def _variants(fp: Column) -> Column:
    """One key for each bit left out: the rest of its segment, and the bit's number above that."""
    keys = []
    for low, bits in SEGMENTS:
        for b in range(low, low + bits):
            mask = (((1 << bits) - 1) << low) & ~(1 << b)
            mask = mask - (1 << 64) if mask >> 63 else mask
            keys.append((F.shiftrightunsigned(fp.bitwiseAND(F.lit(mask)), low) + F.lit(b << 22)).cast("long"))
    return F.array(*keys)


def _first_variant(key: str, x: str) -> str:
    """SQL: whether the key is the first variant that two fingerprints with difference x share."""
    masks = [((1 << n) - 1) << low for low, n in SEGMENTS]
    counts = [f"bit_count({x} & {m - (1 << 64) if m >> 63 else m}L)" for m in masks]
    bit = f"cast(shiftright({key}, 22) as int)"
    say = [f"({bit} >= {low} and {bit} < {low + n} and {c} <= 1 and (({c} = 0 and {bit} = {low}) or (shiftrightunsigned({x}, {bit}) & 1L) = 1L))" for (low, n), c in zip(SEGMENTS, counts, strict=True)]
    return f"({say[0]} or ({counts[0]} > 1 and {say[1]}) or ({counts[0]} > 1 and {counts[1]} > 1 and {say[2]}))"


def _forest(g: pa.Table) -> pa.Table:
    """Edges that connect what the links within a pair of blocks connect, one less than the nodes of each part at most."""
    fps, sides = g["fp"].to_numpy(), g["side"].to_numpy()
    left, right = np.unique(fps[sides == 0]), np.unique(fps[sides == 1])
    right = right if len(right) else left
    nodes = np.unique(np.concatenate([left, right]))
    i, j = np.nonzero(np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :]) <= MAX_BITS)
    i, j = np.searchsorted(nodes, left)[i], np.searchsorted(nodes, right)[j]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return pa.table({"a": nodes[own], "b": nodes[root[own]]})


def links(fps: DataFrame) -> DataFrame:
    """(a, b): edges between distinct fingerprints (fp) that connect just what pairs at MAX_BITS or fewer connect."""
    keyed = fps.select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    crowded = cut(keyed.groupBy("key").count().where(F.col("count") > CROWD))
    marked = keyed.join(crowded, "key", "left")
    few = marked.where("count is null").select("key", "fp")
    x, y = few.alias("x"), few.alias("y")
    diff = "(x.fp ^ y.fp)"
    found = x.join(y, F.expr(f"x.key = y.key and x.fp < y.fp and bit_count({diff}) <= {MAX_BITS} and {_first_variant('x.key', diff)}")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    many = marked.where("count is not null").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # A row meets every block once: as the left side of later ones, the right side of earlier ones, and its own by itself.
    met = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return found.union(met.groupBy("key", "i", "j").applyInArrow(_forest, "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, component, component_id) for each row of docs, with the columns (long) to keep; component is the group's smallest fingerprint."""
    d = cut(fingerprints(docs, shingle, keep).withColumn("_salt", salt_of(F.col("doc_id"))))
    part = cut(d.groupBy("fp", "_salt").agg(F.min("doc_id").alias("least")))
    whole = cut(part.groupBy("fp").agg(F.min("least").alias("least")))
    comp = components(links(whole.select("fp")))
    named = whole.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = with_key_min(named, "component", "least", "component_id").select("fp", "component", "component_id")
    return d.join(part.select("fp", "_salt").join(named, "fp"), ["fp", "_salt"]).select("doc_id", "fp", "component", "component_id", *keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id, and of its rows that of the smallest hash of text, then of the smallest hash of the whole row.

    Rows without a doc_id give way to rows with one. Different texts of one doc_id are judged each in its own group. All columns of docs stay, whatever their names.
    """
    flat = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(hashes_of("text"))
    of = ["doc_id", "_h1", "_h2"]
    rows = near_duplicates(flat, keep=("_h1", "_h2")).groupBy("component", *of).agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), *of, "n")).alias("at"))
    first = cut(first.select(F.col("at.doc_id").alias("_id"), F.col("at._h1").alias("_f1"), F.col("at._h2").alias("_f2"), F.col("at.n").alias("n")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h1") == F.col("_f1")) & (F.col("_h2") == F.col("_f2"))
    flat = flat.drop("text")
    single = flat.join(first.where("n = 1"), same, "left_semi").select("row.*")
    repeats = flat.join(first.where("n > 1"), same, "left_semi").withColumn("_h3", F.xxhash64(F.to_json("row"))).groupBy(*of).agg(F.min_by("row", "_h3").alias("row")).select("row.*")
    return single.unionByName(repeats)
