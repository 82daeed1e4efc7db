"""The keyed digest that all substitutes derive from, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, DateType, StringType, TimestampNTZType, TimestampType


def iso_text(value: Column, kind: DataType) -> Column:
    """Dates and times as ISO-8601 UTC text, with as much of the fraction as there is."""
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, DateType):
        return F.concat(whole, F.lit("Z"))
    fraction = F.regexp_replace(F.date_format(value, ".SSSSSS"), r"\.?0+$", "")
    return F.concat(whole, fraction, F.lit("Z"))


def canonical(value: Column, kind: DataType) -> Column:
    """The text of a value that is digested."""
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return iso_text(value, kind)
    return value if isinstance(kind, StringType) else value.cast("string")


def digest(text: Column, seed: str, salt: int | Column = 0) -> Column:
    """Hex SHA-256 of seed, a zero byte, the text and, if positive, the salt as 8 bytes big-endian."""
    base = F.concat(F.lit(seed).cast(BinaryType()), F.unhex(F.lit("00")), text.cast(BinaryType()))
    if isinstance(salt, int):
        tail = F.unhex(F.lit(f"{salt:016x}" if salt > 0 else ""))
    else:
        tail = F.when(salt > 0, F.unhex(F.lpad(F.hex(salt.cast("long")), 16, "0"))).otherwise(F.unhex(F.lit("")))
    return F.sha2(F.concat(base, tail), 256)


def number(h: Column) -> Column:
    """The first 8 digest bytes as an unsigned number."""
    return F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)")


def modulo(n: Column, m: int) -> Column:
    return (n % F.lit(m).cast("decimal(20,0)")).cast("long")
