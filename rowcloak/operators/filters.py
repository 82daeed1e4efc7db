"""Runtime filters: which rows of a large table can't meet a frontier, told in its scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITMAP = 32_768  # bits of one bitmap of bitmap_construct_agg (a fixed value of Spark)
BITS_A_VALUE, MOST_BITS = 16, 1 << 27
#: From how many values on a filter pays (fewer are a broadcast join anyway), and up to how many it tells enough.
FEW, MANY = 100_000, MOST_BITS // 8


class ValueFilter:
    """A bitmap over the hashes of values, built by one aggregation and broadcast (16 MB at most).

    It lets through every row whose values are among those it was built from, and few others: one in
    sixteen at the size it is made for, more when it is fuller. Null values never pass.
    """

    def __init__(self, values: DataFrame, columns: list[str], n: int):
        self.bits = min(MOST_BITS, max(BITMAP, 1 << (BITS_A_VALUE * max(n, 1) - 1).bit_length()))
        slot = self._slot([F.col(c) for c in columns])
        self.maps = values.select(slot.alias("_slot")).groupBy(F.shiftright("_slot", 15).alias("_map")).agg(
            F.bitmap_construct_agg(F.pmod("_slot", F.lit(BITMAP))).alias("_bits"))

    def _slot(self, columns: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.bits)).cast("long")

    def keep(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """The rows whose values may be among those of the filter; types must be those it was built from."""
        present = rows.where(" and ".join(f"`{c}` is not null" for c in columns)).withColumn("_slot", self._slot([F.col(f"`{c}`") for c in columns]))
        met = present.join(F.broadcast(self.maps), F.shiftright("_slot", 15) == F.col("_map"))
        byte = F.conv(F.hex(F.expr("substring(_bits, cast(pmod(_slot, 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        bit = F.pmod(F.call_function("shiftright", byte, F.pmod("_slot", F.lit(8)).cast("int")), F.lit(2))
        return met.where(bit == 1).select(*rows.columns)
