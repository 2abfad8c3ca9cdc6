"""Tables written once to the shared folder that the cluster names in ``spark.checkpoint.dir``.

A written table reads the same each time, survives lost executors and is read column by column. Where the setting is
absent, as in tests, the folder lies under the warehouse. Folders go when the driver's JVM ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tables"
    return f"{base.rstrip('/')}/graph-{spark.sparkContext.applicationId}"


def write_once(frame: DataFrame) -> DataFrame:
    """frame, written and read back, so that whatever it was made from is neither needed nor run again."""
    spark = frame.sparkSession
    path = f"{shared_root(spark)}/{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
