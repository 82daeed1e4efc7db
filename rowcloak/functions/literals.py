"""SQL literals of typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, MapType, NumericType, StructType, TimestampNTZType, TimestampType

from .digest import iso_text


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def sql_literal(value: Column, kind: DataType) -> Column:
    if isinstance(kind, BooleanType):
        out = F.when(value, F.lit("TRUE")).otherwise(F.lit("FALSE"))
    elif isinstance(kind, NumericType):
        out = value.cast("string")
    elif isinstance(kind, BinaryType):
        out = F.concat(F.lit("'\\x"), F.lower(F.hex(value)), F.lit("'::bytea"))
    elif isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        out = quoted(iso_text(value, kind))
    elif isinstance(kind, (ArrayType, MapType, StructType)):
        out = quoted(F.to_json(value))
    else:
        out = quoted(value.cast("string"))
    return F.when(value.isNull(), F.lit("NULL")).otherwise(out)


def identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'
