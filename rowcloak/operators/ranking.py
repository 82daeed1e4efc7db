"""Row numbers over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise


def global_row_number(df: DataFrame, order: list[str], out: str = "_n") -> DataFrame:
    """``df`` with numbers from 1 in ``order``, which should be unique.

    Range partitions are numbered by themselves and moved by the rows of those before; only one
    count for each partition meets in one place.
    """
    dealt = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    moved = dealt.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_move"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return dealt.join(F.broadcast(moved), "_part").withColumn(out, F.row_number().over(inside) + F.col("_move")).drop("_part", "_move")
