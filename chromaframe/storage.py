"""Intermediate tables in the folder that all executors share, and numbering in an order over many tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names. On one machine, as in tests, a temporary folder does without that setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix=f"{purpose}-")
    return f"{top.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that spark.checkpoint.dir names."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark, "checkpoints"))
    return df.checkpoint()


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row, from 0, in the order of all rows.

    Rows are range-partitioned and numbered where they lie; what each partition begins with comes from one row per
    partition, so no task sees all rows.
    """
    low = (1 << 33) - 1  # what monotonically_increasing_id leaves for places in a partition
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialise(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(low)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    begins = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    return dealt.join(F.broadcast(begins), "_part").withColumn(name, F.col("_begin") + F.col("_at")).drop("_part", "_at", "_begin")
