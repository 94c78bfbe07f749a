"""Cutting lineage through tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch of texts, where the session has left that open.
BATCH_BYTES = 8 << 20


def stored(df: DataFrame) -> DataFrame:
    """df, written below spark.checkpoint.dir (with a local master only, below the warehouse where that is unset) and read again."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df on as many partitions as there are cores, where it has fewer: a small file is read in few splits."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def modest(spark: SparkSession) -> None:
    """Arrow batches of texts by bytes: a worker holds its batch, and ten thousand long texts are too much."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    with contextlib.suppress(Exception):  # a Spark without this setting counts rows only
        if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= BATCH_BYTES:
            spark.conf.set(key, BATCH_BYTES)
