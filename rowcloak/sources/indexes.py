"""Reverse indexes of relationships: child rows bucketed by what they reference, built once and reused by slices.

A child hop asks for the rows that have some reference values. The index of a relationship has the
child's rows (key and the columns of its relationships) bucketed and sorted by the referencing
columns, so such a join shuffles the asked values to the buckets and leaves the index where it is. Values
with more rows than a bucket should hold are kept apart, unbucketed, and joined by themselves. The index
is a table of the session's catalog over files in a folder, which ``open_indexes`` declares again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import ForeignKey, RelationalModel
from ..operators.closure import link_rows, link_view, referencing
from ..scratch import counted
from .commits import Files

ROWS, MOST = 1_000_000, 4_096  # rows of a bucket, and buckets of an index
META = "_index.json"


class ReverseIndex:
    """Child rows by relationship: ``children`` gives the bucketed part and the rows of hot values."""

    def __init__(self, parts: dict[tuple, list[DataFrame]]):
        self.parts = parts

    def children(self, fk: ForeignKey) -> list[DataFrame] | None:
        return self.parts.get(fk.signature)


def _declare(spark: SparkSession, path: str, columns: tuple[str, ...], schema: StructType, buckets: int) -> DataFrame:
    name = f"rowcloak_index_{uuid.uuid4().hex}"
    quote = lambda c: "`" + c.replace("`", "``") + "`"
    by, shape = ", ".join(map(quote, columns)), ", ".join(f"{quote(f.name)} {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({shape}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def build_indexes(model: RelationalModel, folder: str, fks: list[ForeignKey] | None = None, rows: int = ROWS) -> None:
    """Write the index of each relationship below ``folder``, which must not be in use.

    ``rows``: how many a bucket should hold; a value with more of them is hot.
    """
    meta = []
    for i, fk in enumerate(fks if fks is not None else model.fks):
        held = referencing(model, fk, link_rows(model, fk.child))
        spark, columns, total = held.sparkSession, list(fk.columns), Observation()
        sizes = held.groupBy(*columns).agg(F.count("*").alias("_n")).observe(total, F.sum("_n").alias("rows"))
        over, n_over = counted(sizes.where(F.col("_n") > rows).select(*columns), "index-hot")
        buckets = max(1, min(MOST, -(-(total.get["rows"] or 0) // rows)))
        hot = f"{folder}/{i:03d}-hot"
        (held.join(over, columns, "left_semi") if n_over else held.where("false")).select(*held.columns).write.parquet(hot)
        cool = (held.join(over, columns, "left_anti") if n_over else held).select(*held.columns).repartition(buckets, *columns)
        name = f"rowcloak_build_{uuid.uuid4().hex}"
        cool.write.bucketBy(buckets, *columns).sortBy(*columns).option("path", f"{folder}/{i:03d}").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # of an external table that leaves the files
        meta.append({"fk": fk.name, "when": fk.when, "path": f"{i:03d}", "buckets": buckets, "schema": held.schema.jsonValue()})
    Files(model.table(next(iter(model.tables))).df.sparkSession, folder).write(META, json.dumps(meta))


def open_indexes(spark: SparkSession, model: RelationalModel, folder: str) -> ReverseIndex:
    """The indexes below ``folder`` of relationships that the model has, with the columns that it asks for."""
    known, parts = {(f.name, f.when): f for f in model.fks}, {}
    for m in json.loads(Files(spark, folder).read(META)):
        fk = known.get((m["fk"], m["when"]))
        schema = StructType.fromJson(m["schema"])
        if fk and schema.simpleString() == link_view(model, fk.child).schema.simpleString():
            cool = _declare(spark, f"{folder}/{m['path']}", fk.columns, schema, m["buckets"])
            parts[fk.signature] = [cool, spark.read.schema(schema).parquet(f"{folder}/{m['path']}-hot")]
    return ReverseIndex(parts)
