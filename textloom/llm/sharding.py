"""Shards of bounded bytes by extendible hashing, in column expressions only.

The directory is indexed by the leading bits of a document's hash. It starts as one bucket; a bucket above the limit splits on one more bit, and only
such a bucket, until all fit. Bytes are summed once for the prefixes of the directory's finest level and from these for the shorter ones; a bucket is a prefix that fits while its
parent does not. The directory then has an entry for each prefix of as many bits as the deepest bucket has, and documents meet their entries.

What bits cannot split stays exact: rows that share all bits (repeated doc_ids) and exceed the limit are cut into pieces by a running sum, and a row that is larger than the limit by
itself is a shard by itself.

Cases: null and empty texts have no bytes. Null doc_ids hash like the empty string. Repeated rows each count. A text of any length is measured whole. An empty table gives no rows. Extra columns
are ignored by assign() and kept by write().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, running_sum, small, table

#: Bytes of text that a shard holds at most.
LIMIT = 1 << 20
#: Bits of the hash: the leading hex digits of the md5 of doc_id.
BITS = 60
#: Levels of a round after the first, how far the first goes below the level of the mean shard, and levels that are summed at once.
ROUND, SLACK, STEP = 12, 3, 4
#: Cells of a directory (about 50 bytes each) up to which it is sent to every executor.
SMALL = 100_000


def hash_of(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(h: Column, bits: int) -> Column:
    """The first bits of a hash as a number."""
    return F.shiftright(h, BITS - bits)


def pyramid(cells: DataFrame, low: int, high: int) -> DataFrame:
    """(depth, bucket, bytes) of every prefix from `low` to `high` bits of cells (bucket: prefix of `high` bits, bytes).

    Some levels at a time are summed from the finest before them, so that all levels together make few more rows than the cells.
    """
    base = cells.withColumn("depth", F.lit(high)).select("depth", "bucket", "bytes")
    out, at = base, high
    while at > low:
        to = max(low, at - STEP)
        up = base.withColumn("up", F.explode(F.sequence(F.lit(1), F.lit(at - to))))
        coarser = cut(up.select((F.col("depth") - F.col("up")).alias("depth"), F.expr("shiftright(bucket, up)").alias("bucket"), "bytes").groupBy("depth", "bucket").agg(F.sum("bytes").alias("bytes")))
        out, base, at = out.unionByName(coarser), coarser.where(F.col("depth") == to), to
    return out


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(cell_bits, cell, depth, bucket, shard_bytes): the directory, an entry for each prefix of cell_bits bits, and the bucket it points to; depth is null for entries of BITS bits above the limit.

    A bucket is a prefix within the limit whose parent, one bit shorter, is above it: two siblings add up to their parent, so each prefix is judged beside its
    sibling only. Prefixes still above the limit at the finest level go on to a directory of more bits. rows: (h, bytes), no row above the limit.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(1, math.ceil(math.log2(max(1.0, total / limit))) + SLACK))
    found, open_rows = None, rows
    pair = F.sum("bytes").over(Window.partitionBy("depth", F.shiftright("bucket", 1)))
    while True:
        cells = cut(open_rows.withColumn("bucket", prefix(F.col("h"), high)).groupBy("bucket").agg(F.sum("bytes").alias("bytes")))
        levels = pyramid(cells, low, high).where(F.col("depth") > 0)
        whole = cells.agg(F.sum("bytes").alias("bytes")).where((F.lit(low) == 0) & (F.col("bytes") <= limit)).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("bucket"), "bytes")
        split = levels.where(F.col("depth") > low).withColumn("parent", pair).where((F.col("bytes") <= limit) & (F.col("parent") > limit)).drop("parent")
        buckets = cut(split.unionByName(whole).withColumnRenamed("bytes", "shard_bytes"))
        top = max(low, buckets.agg(F.max("depth")).first()[0] or 0)  # bits of the directory
        first = F.expr(f"shiftleft(bucket, {top} - depth)")
        done = cut(buckets.withColumn("cell", F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {top} - depth)") - 1))).select(F.lit(top).alias("cell_bits"), "cell", "depth", "bucket", "shard_bytes"))
        found = done if found is None else found.unionByName(done)
        stuck = cut(cells.where(F.col("bytes") > limit))
        if stuck.isEmpty():
            return found
        if high == BITS:
            none = F.lit(None)
            return found.unionByName(stuck.select(F.lit(high).alias("cell_bits"), F.col("bucket").alias("cell"), none.cast("int").alias("depth"), none.cast("long").alias("bucket"), none.cast("long").alias("shard_bytes")))
        keyed = open_rows.withColumn("bucket", prefix(F.col("h"), high))
        open_rows = cut(keyed.join(small(stuck.select("bucket"), SMALL), "bucket", "left_semi").select("h", "bytes"))
        low, high = high, min(BITS, high + ROUND)


def placed(rows: DataFrame, limit: int) -> DataFrame:
    """rows (h, bytes, and other columns) with shard, depth and shard_bytes.

    shard is the bucket's bits, with '#' and a piece's number where bits could not split it; depth counts the bits. Only a shard of one row passes the limit.
    """
    rows = cut(rows)
    within = rows.where(F.col("bytes") <= limit)
    where = cut(directory(within.select("h", "bytes"), limit))
    sizes = [r[0] for r in where.select("cell_bits").distinct().collect()]  # a number for each round
    found = None
    for bits in sizes:
        of = small(where.where(F.col("cell_bits") == bits).drop("cell_bits"), SMALL)
        part = within.withColumn("cell", prefix(F.col("h"), bits)).join(of, "cell").drop("cell")
        found = part if found is None else found.unionByName(part)
    name = lambda depth, bucket: F.when(depth == 0, "").otherwise(F.substring(F.lpad(F.bin(bucket), BITS, "0"), F.lit(BITS + 1) - depth, depth))
    out = lambda df, shard, depth, size: df.select(*rows.columns, shard.alias("shard"), depth.cast("int").alias("depth"), size.cast("long").alias("shard_bytes"))
    full = F.lit(BITS)
    # A row above the limit is a shard by itself, with a number of its own, as such rows may repeat. Rows of one hash and size are told apart by a number of chance.
    apart = ["h", "bytes", "apart"]
    large = cut(rows.where(F.col("bytes") > limit).withColumn("apart", F.rand(7)))
    single = out(large, F.lit(""), full, F.col("bytes")).limit(0)
    if not large.isEmpty():
        numbered = running_sum(large.withColumn("one", F.lit(1)), apart, "one", "number")
        single = out(numbered, F.concat(name(full, F.col("h")), F.lit("#large"), F.col("number").cast("string")), full, F.col("bytes"))
    if found is None:
        return single
    result = out(found.where("depth is not null"), name(F.col("depth"), F.col("bucket")), F.col("depth"), F.col("shard_bytes")).unionByName(single)
    if where.where("depth is null").isEmpty():
        return result
    # Rows of one hash above the limit: pieces that start every `step` bytes of a running sum end within the limit.
    over = cut(found.where("depth is null").select(*rows.columns, F.rand(7).alias("apart")))
    step = max(1, limit - (over.agg(F.max("bytes")).first()[0] or 0))
    pieces = cut(running_sum(over, apart, "bytes", "start").withColumn("piece", F.floor(F.col("start") / step)))
    held = pieces.groupBy("h", "piece").agg(F.sum("bytes").alias("shard_bytes"))
    pieces = pieces.join(held, ["h", "piece"])
    return result.unionByName(out(pieces, F.concat(name(full, F.col("h")), F.lit("#"), F.col("piece").cast("string")), full, F.col("shard_bytes")))


def _measures() -> list[Column]:
    """bytes and h of a document."""
    return [F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), hash_of(F.col("doc_id").cast("long")).alias("h")]


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, doc_bytes, shard, depth, shard_bytes) for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_measures())
    return placed(rows, limit).select("doc_id", F.col("bytes").alias("doc_bytes"), "shard", "depth", "shard_bytes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes docs as Parquet, a folder for each shard (column shard, which replaces one of docs); each row goes to the shard that holds it, by its own size and hash."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard"]).alias("row"), *_measures())
    met = placed(rows, limit).select("row.*", "shard")
    met.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)
