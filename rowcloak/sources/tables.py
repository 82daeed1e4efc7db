"""Models over Parquet folders, and logical tables over partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..model import ForeignKey, RelationalModel, TableSpec


def load_tables(spark: SparkSession, folder: str, specs: dict[str, dict], fks: list[ForeignKey] = ()) -> RelationalModel:
    """Bind the named tables to ``folder/<name>.parquet``; others there stay out of sight.

    ``specs`` maps a table to the keyword arguments of its TableSpec. Data from any other source
    comes by building TableSpec with a DataFrame of one's own.
    """
    return RelationalModel([TableSpec(n, spark.read.parquet(f"{folder}/{n}.parquet"), **kw) for n, kw in specs.items()], fks)


def logical_table(partitions: list[DataFrame]) -> DataFrame:
    """The one table that partitions belong to."""
    return reduce(lambda a, b: a.unionByName(b), partitions)


#: Keys of the star-schema tables.
STAR = {
    "region": {"pk": ("r_regionkey",)},
    "nation": {"pk": ("n_nationkey",)},
    "customer": {"pk": ("c_custkey",), "uniques": (("c_name",),), "not_null": frozenset({"c_name"})},
    "supplier": {"pk": ("s_suppkey",)},
    "part": {"pk": ("p_partkey",)},
    "orders": {"pk": ("o_orderkey",)},
    "lineitem": {},
    "events": {"pk": ("event_id",)},
}
TEXTS = {
    "documents": {"pk": ("doc_id",)},
    "labels": {"pk": ("doc_id",)},
    "conversations": {"pk": ("conv_id", "turn")},
    "pages": {"pk": ("page_id",)},
    "benchmark": {"pk": ("item_id",)},
}
STAR_FKS = [
    ForeignKey("nation", ("n_regionkey",), "region", ("r_regionkey",)),
    ForeignKey("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)),
    ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    ForeignKey("lineitem", ("l_partkey",), "part", ("p_partkey",)),
    ForeignKey("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
]
EVENTS_FK = ForeignKey("events", ("user_id",), "customer", ("c_custkey",), virtual=True)
LABELS_FK = ForeignKey("labels", ("doc_id",), "documents", ("doc_id",))


def star_model(spark: SparkSession, folder: str, events: bool = True) -> RelationalModel:
    specs = STAR if events else {k: v for k, v in STAR.items() if k != "events"}
    return load_tables(spark, folder, specs, [*STAR_FKS, *([EVENTS_FK] if events else [])])


def full_model(spark: SparkSession, folder: str) -> RelationalModel:
    return load_tables(spark, folder, STAR | TEXTS, [*STAR_FKS, EVENTS_FK, LABELS_FK])
