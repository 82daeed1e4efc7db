"""Tables that cut lineage, in the shared folder of the cluster."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; a local one where that is not set, as in tests.

    On a cluster a local folder would be a different one for each executor, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/rowcloak/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    return counted(df, label)[0]


def counted(df: DataFrame, label: str = "table") -> tuple[DataFrame, int]:
    """The table written and read back, and how many rows it has, which the same job counts."""
    path, schema, seen = scratch_path(df.sparkSession, label), df.schema, Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path), seen.get["n"]


def forget(df: DataFrame) -> None:
    """Delete the files of a table made here, once nothing will read it again."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/rowcloak/" in folder:
            p = jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(conf).delete(p, True)
