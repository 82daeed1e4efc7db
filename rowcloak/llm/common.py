"""Helpers shared by the training-data operators: scratch tables, text views, a native key filter."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

BITMAP_BITS = 32768  # bits in one bitmap of bitmap_construct_agg (a fixed value of Spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent (tests, a laptop) a local folder is used instead, which on a cluster
    would be another one for each executor, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/rowcloak/{label}-{uuid.uuid4().hex}"


#: For tables with rows of many kilobytes: a reader holds a row group's values at once, and by default no group ends before its hundredth row.
HEAVY = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def write_table(df: DataFrame, label: str, compression: str = "zstd", sort: list[str] | None = None, heavy: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back; ``heavy`` ends row groups after a few large rows."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    out = df.sortWithinPartitions(*sort) if sort else df
    schema = out.schema
    out.write.option("compression", compression).options(**(HEAVY if heavy else {})).parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by write_table, once nothing will read it again."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/rowcloak/" in folder:
            p = jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, a null one being empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_fold(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null value falls in fold 0."""
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n)), F.lit(0)).cast("int")


def filter_bits(n: int) -> int:
    """Bits for a filter over ``n`` keys: eight a key, from one bitmap to 2^27 bits (16 MB)."""
    return min(1 << 27, max(BITMAP_BITS, 1 << (8 * max(n, 1) - 1).bit_length()))


class KeyFilter:
    """A one-hash bitmap over long keys, built and probed with native functions only.

    The bitmap has ``bits`` bits, so its broadcast is bounded (``bits / 8`` bytes); ``filter_bits``
    sizes it by the number of keys within a bound. It lets most rows without a partner stay where
    they are; it gives no false negatives, so when it fills up only the shuffle grows, never the result.
    """

    def __init__(self, keys: DataFrame, key: Column, bits: int = 1 << 24, maps: DataFrame | None = None):
        self.bits = bits
        slot = F.pmod(key, F.lit(bits)).cast("long")
        self.maps = maps or keys.select(slot.alias("_slot")).groupBy(F.floor(F.col("_slot") / BITMAP_BITS).alias("_bucket")).agg(
            F.bitmap_construct_agg(F.pmod(F.col("_slot"), F.lit(BITMAP_BITS))).alias("_bitmap"))

    def mark(self, df: DataFrame, key: Column, flag: str) -> DataFrame:
        """``df`` with a boolean column: may the key be among the keys? A null key is never."""
        slot = F.pmod(key, F.lit(self.bits)).cast("long")
        out = df.withColumn("_slot", slot).join(
            F.broadcast(self.maps), F.floor(F.col("_slot") / BITMAP_BITS) == F.col("_bucket"), "left")
        at = F.pmod(F.col("_slot"), F.lit(BITMAP_BITS)).cast("int")
        byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(pmod(_slot, 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        hit = F.expr("shiftright({0}, cast(pmod(_slot, 8) as int))".format("_byte"))
        return (out.withColumn("_byte", F.when(at.isNotNull(), byte))
                .withColumn(flag, F.coalesce(F.pmod(hit, F.lit(2)) == 1, F.lit(False)))
                .drop("_slot", "_bucket", "_bitmap", "_byte"))


def quoted(names: list[str]) -> list[str]:
    """Column names that select() takes as they are, dots included."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def map_beside(df: DataFrame, kept: list[str], inputs: list[Column], run, new: list[StructField]) -> DataFrame:
    """The kept columns and the ``new`` ones that ``run`` makes of ``inputs``, batch by batch.

    ``run`` gets Arrow batches of the kept columns as one struct, then the inputs, and gives the
    struct and the new columns; so no name of the table's can clash or be misread.
    """
    row = df.select(F.struct(*quoted(kept)).alias("_row"), *(c.alias(f"_in{i}") for i, c in enumerate(inputs)))
    schema = StructType([StructField("_row", row.schema["_row"].dataType), *new])
    return row.mapInArrow(run, schema).select("_row.*", *(f.name for f in new))


def packed(docs: DataFrame, replaced: list[str]) -> DataFrame:
    """(_row, doc_id, text): the columns but the replaced ones as a struct, where no name clashes."""
    kept = quoted([c for c in docs.columns if c not in replaced])
    return docs.select(F.struct(*kept).alias("_row"), "doc_id", "text")


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, row: list[str], salts: int = 64, how: str = "inner") -> DataFrame:
    """Join (inner or left) whose hot keys (``hot`` has the key columns) are dealt over ``salts`` tasks each.

    A bitmap tells on both sides alike which keys are hot: left rows take a salt from the columns
    ``row``, right rows come once for each salt. A key taken for hot by mistake is only copied.
    """
    key = F.xxhash64(*keys)
    few = KeyFilter(hot, key, 1 << 20)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*row), F.lit(salts))).otherwise(0).cast("int")
    a = few.mark(left, key, "_hot").withColumn("_salt", salt).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    b = few.mark(right, key, "_hot").withColumn("_salt", F.explode(every)).drop("_hot")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def salts_for(most: int | None, share: int, limit: int = 4096) -> int:
    """Over how many tasks a key of ``most`` rows is dealt so that each gets about ``share``."""
    return max(1, min(limit, -(-(most or 0) // share)))
