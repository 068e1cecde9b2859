"""Pieces that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, for trimming.
BLANKS = " \t\n\x0b\x0c\r"
#: Sub-keys that a key's rows are dealt to before they meet.
SALTS = 64
#: Edges that a task contracts at once.
AT_ONCE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder that the session has. One of our own is for one machine only (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/textloom-checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder that fresh_dir() named, on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept, with its lineage cut, where every executor can read it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows, as one text may be megabytes long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is computed within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def salt_of(col: Column) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(SALTS)).cast("int")


def hashes_of(*names: str) -> dict[str, Column]:
    """_h1 and _h2, 128 bits of hash of some columns as text; nulls are values of their own."""
    parts = [x for n in names for x in (F.col(n).isNull(), F.col(n).cast("string"))]
    return {f"_h{i}": F.xxhash64(F.lit(i), *parts) for i in (1, 2)}


def with_key_min(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """df with min(value) over the rows of equal key; any one key may hold any share of the rows.

    Rows meet by (key, salt); only one row a salt meets by key. df is read twice: cut it before if it is costly. Keys are not null.
    """
    dealt = df.withColumn("_salt", salt_of(F.col(value)))
    part = dealt.groupBy(key, "_salt").agg(F.min(value).alias("_least"))
    whole = part.groupBy(key).agg(F.min("_least").alias(out))
    return dealt.join(part.select(key, "_salt").join(whole, key), [key, "_salt"]).drop("_salt")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has so many rows at most; else the join is planned by size. df is read once for that: cut it before."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of the nodes 0 to n - 1 that each reaches by edges between i and j. Roots are hooked to smaller ones, then paths are cut short, so that rounds grow with logarithms even of long paths."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, a, b)
        np.minimum.at(root, b, a)
        while (root != (shorter := root[root])).any():
            root = shorter


def _contracted(edges: DataFrame, most: int) -> DataFrame:
    """(hi, lo): stars that connect what each `most` edges of a partition connect, a row a node, its smallest with itself. edges: two columns (long)."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots(len(nodes), at[: len(a)], at[len(a) :])])], ["hi", "lo"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for x in batches:
            if held and n + x.num_rows > most:
                yield star(held)
                held, n = [], 0
            held, n = [*held, x] if x.num_rows else held, n + x.num_rows
        if held:
            yield star(held)

    return edges.mapInArrow(run, "hi long, lo long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b: long): the smallest node reachable.

    Each task contracts its edges to stars; what is left is contracted again by tasks of AT_ONCE edges, which ends it if one such task takes all. Beyond that, alternating
    large-star and small-star (Kiveris et al., 2014): the edges never outgrow their number at the start, and the
    rounds grow with the logarithm of the longest path. Only counts and a checksum come to the driver.
    """
    e = cut(_contracted(edges.where("a <> b").select("a", "b"), AT_ONCE).where("hi <> lo"))
    tasks = -(-e.count() // AT_ONCE)
    e = cut(_contracted(e.coalesce(max(1, tasks)), AT_ONCE))
    if tasks <= 1:
        return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    e = cut(e.where("hi <> lo").distinct())
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(hi, lo))")).first()
        if tuple(now) == before or now[0] == 0:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())
        before = tuple(now)
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        large = with_key_min(both, "u", "v", "m").where("v > u").select(F.col("v").alias("hi"), F.least("m", "u").alias("lo")).distinct()
        small = with_key_min(large, "hi", "lo", "m")
        e = cut(small.select("hi", F.col("m").alias("lo")).union(small.where("lo <> m").select("lo", "m")).distinct())


def running_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with the sum of value over the rows before each, in ascending order, nulls last.

    Range partitions are summed, then each row within its own; only one number a partition meets in one task.
    """
    sort = [x for c in order for x in (F.col(c).isNull(), F.col(c))]
    parts = cut(df.repartitionByRange(*sort).withColumn("_part", F.spark_partition_id()))
    before = F.sum("_sum").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1))
    joined = parts.join(F.broadcast(sums), "_part")  # a row for each partition
    return joined.withColumn(out, (F.col("_before") + F.coalesce(within, F.lit(0))).cast("long")).drop("_part", "_before")


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for sizes[i] numbers, for each i."""
    before = np.cumsum(sizes, dtype=np.int32)
    out = np.arange(before[-1] if len(before) else 0, dtype=np.int32)
    out += np.repeat((starts - (before - sizes)).astype(np.int32), sizes)
    return out
