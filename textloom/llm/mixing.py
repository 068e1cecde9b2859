"""Mixes sources to target weights by exact budgets of words.

Each row gets a hash-random key. Rows are range-sorted by key within their source: first into ranges of the key, then within a
range. Sums of sizes by range, then by row, give each row's distributed prefix sum, and each source is cut at its exact budget. A
budget above the source's size takes the whole source so many times and cuts the last epoch.

Cases: null and empty texts have size 0 and are never taken in words; a null source is a source of its own, last in order. Repeated rows count each
for themselves; equal keys are ordered by doc_id and size, and rows equal in source, doc_id and size are one row with a number until the end. A text of any length
is counted whole. An empty table gives no rows. Extra columns are ignored by mix() and kept by mixed().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SALTS, WORD, cut, salt_of, small, table

WEIGHTS = (5, 2, 1)
#: Most epochs of a source.
EPOCHS = 3
#: Rows of a key range that are aimed at, and the most ranges of a source.
RANGE_ROWS, RANGES = 256, 16384
#: The key: so many hex digits of the md5 of doc_id.
KEY_DIGITS = 13


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Adds weight and target (double) to (source, source_size, ...), one row per source.

    Sources in order of code points, null last, take the weights in turn. Sources whose share is above epochs times their size stop there and
    the excess is shared anew, until none is above. Only sums come to the driver.
    """
    # Ranks without one task for all: range-sorted parts, counted, then ranked within themselves.
    last = F.col("source").isNull().cast("int")
    parts = cut(sources.repartitionByRange(last, "source").withColumn("_part", F.spark_partition_id()))
    before = parts.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(last, "source")) - 1
    ranked = parts.join(before, "_part").withColumn("_rank", rank)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))
    s = cut(ranked.withColumn("weight", weight.cast("long")).drop("_part", "_before", "_rank"))
    most = F.col("source_size") * epochs
    free, total, share = F.lit(True), None, 0.0
    while True:
        got = s.agg(F.sum("source_size"), F.sum(F.when(~free, most).otherwise(0)), F.sum(F.when(free, F.col("weight")).otherwise(0)), F.sum(free.cast("int"))).first()
        total, capped, left, n_free = (x or 0 for x in got)
        share = (total - capped) / left if left else 0.0
        within = most >= F.lit(share) * F.col("weight")
        if s.where(free & ~within).isEmpty():
            return s.withColumn("target", F.when(free, F.lit(share) * F.col("weight")).otherwise(most.cast("double")))
        free = free & within


def _key(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, KEY_DIGITS), 16, 10).cast("long")


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, key, prefix, taken) for each row: prefix is the size of the rows before it in its source's order."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size(F.col("text")).alias("size"), _key(F.col("doc_id")).alias("key"))
    # Rows equal in all that counts are one row with a number here, so that copies under one doc_id or none fill no window.
    sized = cut(sized.groupBy("source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")))
    sources = targets(cut(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("n_rows"))), weights, epochs)
    # Sources meet rows by (source, salt of the key), as one source may hold most rows.
    sources = sources.select(F.col("source").alias("_source"), "source_size", "target", F.least(F.lit(RANGES), F.ceil(F.col("n_rows") / RANGE_ROWS)).cast("long").alias("ranges"))
    dealt = small(cut(sources.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))), 10_000 * SALTS)
    top = 16**KEY_DIGITS
    rows = sized.withColumn("_salt", salt_of(F.col("key"))).alias("d").join(dealt.alias("s"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("d._salt") == F.col("s._salt"))).drop("_source", "_salt")
    rows = cut(rows.withColumn("range", F.floor(F.col("key") * (F.col("ranges") / F.lit(float(top)))).cast("long")))
    by_range = rows.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("range_size"))
    before = F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    by_range = by_range.withColumn("before", F.coalesce(before, F.lit(0))).withColumnsRenamed({"source": "_source", "range": "_range"}).drop("range_size")
    rows = rows.join(by_range, rows["source"].eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range"))).drop("_source", "_range")
    within = F.sum(F.col("size") * F.col("copies")).over(Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("prefix", F.col("before") + F.coalesce(within, F.lit(0)))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("prefix", F.col("prefix") + F.col("_copy") * F.col("size"))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("epochs", whole).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("prefix")))
    return rows.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long")).drop("before", "ranges", "copies", "_copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs as the mix takes them: each whole text as often as it is taken, the last epoch's cut rounded to whole texts. All columns of docs stay, whatever their names.

    A row at a cut is taken where at least half its words are. A row without a word is taken as often as its source's epochs say.
    """
    rows = mix(docs)
    part = F.col("taken") - F.col("epochs") * F.col("size")
    times = F.col("epochs") + F.when(F.col("size") > 0, (2 * part >= F.col("size")).cast("long")).otherwise((F.col("prefix") < F.col("rest")).cast("long"))
    taken = rows.groupBy("doc_id", "source", "size").agg(F.sum(times).alias("_times"), F.count(F.lit(1)).alias("_rows"))
    taken = taken.withColumnsRenamed({"doc_id": "_id", "source": "_source", "size": "_size"})
    flat = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"))
    met = flat.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    # Rows that repeat a doc_id share what they are taken together; the hash of the text says which get one more.
    more = (F.pmod("hash", F.col("_rows")) < F.col("_times") % F.col("_rows")).cast("long")
    each = (F.floor(F.col("_times") / F.col("_rows")) + more).cast("int")
    return met.withColumn("_each", each).where("_each > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_each")))).select("row.*")
