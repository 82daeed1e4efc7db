"""Masking and scanning data in transit; masking and findings by batch are stateless, running findings are not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.detect import CHECKS
from ..functions.rules import mask
from ..operators.scan import scan_frame


def mask_stream(stream: DataFrame, rules: dict[str, str], seed: str) -> DataFrame:
    """The stream with the rules' columns masked, as a batch would be (uniqueness isn't repaired)."""
    return stream.select(*(mask(F.col(c), rules.get(c, "keep"), stream.schema[c].dataType, seed).alias(c) for c in stream.columns))


def scan_stream(stream: DataFrame, name: str, key: list[str], findings_path: str, checks=CHECKS) -> DataStreamWriter:
    """A writer that scans each micro-batch and appends its findings, with the batch's number.

    A batch that runs again after a failure replaces its own findings.
    """
    def each(batch: DataFrame, number: int) -> None:
        scan_frame(batch, name, key, checks).write.mode("overwrite").parquet(f"{findings_path}/batch={number}")

    return stream.writeStream.foreachBatch(each)


def running_scan(stream: DataFrame, name: str, key: list[str], path: str, checks=CHECKS) -> DataStreamWriter:
    """Findings of the stream so far: counts and first samples are kept in the state store from batch to batch.

    Every batch writes all findings to ``path/batch=N``, of which ``latest_findings`` reads the last;
    a batch that is tried again overwrites its own. The state has a row for each column and check.
    """
    def publish(df: DataFrame, batch: int) -> None:
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return scan_frame(stream, name, key, checks).writeStream.outputMode("complete").foreachBatch(publish)


def latest_findings(spark: SparkSession, path: str) -> DataFrame:
    """What the last whole batch of ``running_scan`` found."""
    every = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    last = every.agg(F.max("batch").alias("batch"))
    return every.join(F.broadcast(last), "batch").drop("batch")
