"""Running sums over rows in a total order, without one task for all."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df computed once, in the folder that executors share. A folder of our own where the session names none serves one machine only (tests)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.gettempdir()}/textloom-checkpoints")
    return df.checkpoint()


def running_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with the sum of value over the rows before each, nulls last: sums of range partitions, then of rows within theirs."""
    sort = [x for c in order for x in (F.col(c).isNull(), F.col(c))]
    parts = kept(df.repartitionByRange(*sort).withColumn("_part", F.spark_partition_id()))
    before = F.sum("_sum").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum")).select("_part", F.coalesce(before, F.lit(0)).alias("_before_part"))
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1))
    return parts.join(F.broadcast(sums), "_part").withColumn(out, F.col("_before_part") + F.coalesce(within, F.lit(0))).drop("_part", "_before_part")
