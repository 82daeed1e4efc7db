"""Where slices go: published Parquet tables, SQL scripts, and metadata files."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ModelError, RelationalModel
from ..operators.loading import LoadPlan, load, load_plan
from .commits import ParquetSink, current
from .script import ScriptSink


def _same_place(a: str, b: str) -> bool:
    plain = lambda p: p.removeprefix("file:").replace("//", "/").rstrip("/")
    return plain(a) == plain(b)


def target_status(spark: SparkSession, model: RelationalModel, path: str) -> DataFrame:
    """(table_name, is_there, has_rows) of each table in what was published below ``path``."""
    there = current(spark, path).tables
    rows = [(t, t in there, t in there and there[t].n_rows > 0) for t in model.tables]
    return spark.createDataFrame(rows, "table_name string, is_there boolean, has_rows boolean")


def write_slice(model: RelationalModel, frames: dict[str, DataFrame], path: str, mode: str = "errorifexists", source: str | None = None, plan: LoadPlan | None = None) -> list[str]:
    """Write the tables below ``path``, all or none, in load order, which comes back; ``commits.read_tables`` reads them.

    ``overwrite`` replaces what is there, ``append`` adds and refuses keys that are there already,
    ``errorifexists`` refuses a table that is there. References that cycles defer are null in their
    tables and a dataset of their own beside them. The source itself is never a target.
    """
    if source and _same_place(source, path):
        raise ModelError("the target is the source")
    spark = next(iter(frames.values())).sparkSession
    return load(model, frames, ParquetSink(spark, path, mode), plan).order


def each_table(model: RelationalModel, frames: dict[str, DataFrame], sink: Callable[[str, DataFrame], None]) -> None:
    """Hand every table, whole, to a function, parents first; ``loading.load`` has sinks with a life cycle."""
    own = RelationalModel([model.table(t) for t in frames], [f for f in model.fks if f.child in frames and f.parent in frames])
    for t in load_plan(own).order:
        sink(t, frames[t])


def write_sql(model: RelationalModel, frames: dict[str, DataFrame], path: str, schema: str = "public", overwrite: bool = False, plan: LoadPlan | None = None) -> list[str]:
    """The load as one SQL script below ``path``: rows in load order, deferred references, sequences, in one transaction."""
    return load(model, frames, ScriptSink(path, schema, overwrite), plan).order


def next_key_values(model: RelationalModel) -> DataFrame:
    """(table_name, column_name, value, is_called): where each owned sequence goes on."""
    out = []
    for t in model.tables.values():
        for c in t.sequences:
            out.append(t.df.agg(F.coalesce(F.max(c), F.lit(1)).cast("long").alias("value"), F.max(c).isNotNull().alias("is_called")).select(
                F.lit(t.name).alias("table_name"), F.lit(c).alias("column_name"), "value", "is_called"))
    return reduce(DataFrame.unionByName, out)


def write_summaries(summary: DataFrame, rules: DataFrame, path: str) -> None:
    """Metadata of a run, never rows of data, in a fixed order."""
    summary.orderBy("table_name").coalesce(1).write.json(f"{path}/summary")
    summary.orderBy("table_name").coalesce(1).write.csv(f"{path}/tables", header=True)
    rules.orderBy("table_name", "column_name").coalesce(1).write.csv(f"{path}/rules", header=True)
