"""End to end: a referentially complete, masked slice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import RelationalModel, TableSpec
from .closure import CHILD_LIMIT, ROOT_LIMIT, closure, read_slice, root_keys
from .masking import Classifier, mask_table, require_reviewed


def slice_model(model: RelationalModel, root: str, seed: str, where: str | None = None, limit: int | None = ROOT_LIMIT, sample_percent: float | None = None,
                child_depth: int = 1, child_limit: int | None = CHILD_LIMIT, classifier: Classifier | None = None, strict: bool = True,
                pii_tables: list[str] | None = None) -> dict[str, DataFrame]:
    """The rows of the closure of the root rows, masked, for each table that has any.

    ``strict``: refuse text columns that nobody has ruled on; without, they pass as they are.
    """
    classifier = classifier or Classifier()
    if strict:
        require_reviewed(model, classifier, pii_tables)
    keys = closure(model, root, root_keys(model, root, where, limit, sample_percent, required=True), child_depth, child_limit)
    return {t: mask_table(model, t, seed, classifier, read_slice(model, k, t)) for t, k in keys.items()}


def sliced(model: RelationalModel, frames: dict[str, DataFrame]) -> RelationalModel:
    """A slice as a model of its own, with the relationships among its tables."""
    specs = [TableSpec(**{**model.table(t).__dict__, "df": df}) for t, df in frames.items()]
    return RelationalModel(specs, [f for f in model.fks if f.child in frames and f.parent in frames])


def slice_summary(model: RelationalModel, keys: dict[str, DataFrame], classifier: Classifier | None = None) -> DataFrame:
    """(table_name, n_source, n_extracted, n_masked_columns) of each table, then a total."""
    classifier, out = classifier or Classifier(), []
    for t in model.tables.values():
        protected = model.key_columns(t.name) | set(t.generated)
        masked = sum(c not in protected and classifier.rule(t.name, c) != "keep" for c in t.df.columns)
        count = lambda df, c: df.agg(F.count("*").alias(c)).select(F.lit(t.name).alias("table_name"), c, F.lit(masked).cast("long").alias("n_masked_columns"))  # noqa: B023, E731
        out.append(count(t.df, "n_source").withColumn("n_extracted", F.lit(0).cast("long")))
        if t.name in keys:
            out.append(count(keys[t.name], "n_extracted").withColumn("n_source", F.lit(0).cast("long")))
    rows = reduce(DataFrame.unionByName, out).groupBy("table_name").agg(
        F.sum("n_source").alias("n_source"), F.sum("n_extracted").alias("n_extracted"), F.max("n_masked_columns").alias("n_masked_columns"))
    total = rows.agg(*(F.sum(c).alias(c) for c in ("n_source", "n_extracted", "n_masked_columns"))).select(F.lit("total").alias("table_name"), "*")
    return rows.unionByName(total)


def partition_rollup(parts: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(table_name, n_rows): leaf partitions' rows summed up for the table they belong to."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(parent).alias("table_name"), "n") for parent, df in parts.values()]
    return reduce(DataFrame.unionByName, rows).groupBy("table_name").agg(F.sum("n").alias("n_rows"))
