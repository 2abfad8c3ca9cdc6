"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

A written table cuts the lineage and survives lost executors. Where the setting is absent, as in
tests, the folder lies under the warehouse. Folders go when the driver's JVM ends.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/weft-{spark.sparkContext.applicationId}"


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within it, Python gets at most so many rows at once: texts are long, and a batch stands in memory on both sides."""
    before = spark.conf.get(BATCH)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def materialize(df: DataFrame, label: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write df to the shared scratch folder and return it as a table read from there."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(hadoop).deleteOnExit(folder)
    with small_batches(spark, batch_rows):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A side of at most so many rows (of a few fixed-width columns each) may be broadcast: tens of MB at most.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a count shows df to have limit rows at most."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows it to be small; otherwise as it is, to be joined by a shuffle."""
    return F.broadcast(df) if small(df, limit) else df


def shuffled_join(big: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which adaptive execution can split hot keys.

    Spark splits a skewed partition only if an exchange stands right under each side of the join. A side that
    has just been aggregated by the same keys has none, so a derived key, of one bit, is added to make both sides exchange.
    """
    extra = F.xxhash64(*[F.col(k) for k in keys]).bitwiseAND(F.lit(1))
    cond_big, cond_other = big.withColumn("__weft_jk", extra), other.withColumn("__weft_jk", extra)
    return cond_big.join(cond_other.hint("merge"), [*keys, "__weft_jk"], how).drop("__weft_jk")


def join(big: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """big joined with other: by broadcast if a count shows other to be small, else by a shuffle that can split hot keys."""
    return big.join(F.broadcast(other), keys, how) if small(other) else shuffled_join(big, other, keys, how)
