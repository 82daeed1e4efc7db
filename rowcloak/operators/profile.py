"""Profiles: what a catalog would say about columns and keys, measured on the data."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructField

from ..model import RelationalModel, TableSpec
from .masking import Classifier, recommend


def _comparable(f: StructField) -> Column:
    """The column as something that can be counted by value."""
    c = F.col(f"`{f.name}`")
    return F.when(c.isNotNull(), F.to_json(F.struct(c))) if f.dataType.typeName() in ("array", "map", "struct", "variant") else c


def _is_text(f: StructField) -> bool:
    return f.dataType.typeName() in ("string", "varchar")


def profile_frame(df: DataFrame, name: str) -> DataFrame:
    """(table_name, column_name, type, n_rows, n_null, n_distinct, max_length) of each column, exact.

    One scan of the table: a row goes on once for each column, with that column's value in its own
    type, and distinct values are counted after a partial aggregation. ``ProfileStore`` estimates
    them from sketches instead, and reads each file once.
    """
    fields = df.schema.fields
    own = df.select(*(_comparable(f).alias(f"v{i}") for i, f in enumerate(fields)))
    aggs = [x for i, f in enumerate(fields) for x in (
        F.count(f"v{i}").alias(f"set{i}"), F.count_distinct(f"v{i}").alias(f"distinct{i}"),
        (F.max(F.length(f"v{i}")).cast("long") if _is_text(f) else F.lit(None).cast("long")).alias(f"longest{i}"))]
    facts = own.agg(F.count("*").alias("n"), *aggs)
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"set{i}")).alias("n_null"),
                     F.col(f"distinct{i}").alias("n_distinct"), F.col(f"longest{i}").alias("max_length")) for i, f in enumerate(fields)]
    return facts.select(F.lit(name).alias("table_name"), F.inline(F.array(*rows)))


def profile_by_column(df: DataFrame, name: str) -> DataFrame:
    """What ``profile_frame`` gives, for tables that are cheap to read again: each column is read and counted by itself.

    What is shuffled is a value and its number for each task, however wide the table; counting all
    columns at once sends every row once for each column, with a place for all of them.
    """
    out = []
    for f in df.schema.fields:
        values = df.select(_comparable(f).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
        longest = F.max(F.length("v")).cast("long") if _is_text(f) else F.lit(None).cast("long")
        out.append(values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
                              F.count("v").alias("n_distinct"), longest.alias("max_length")).select(
            F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), "n_rows", "n_null", "n_distinct", "max_length"))
    return reduce(DataFrame.unionByName, out)


class ProfileStore:
    """Profiles that grow with their tables: what one scan of a file says is kept, and merged for the table.

    For each file and column the store has counts, bounds, the greatest length, a HyperLogLog sketch of the
    values and, for numbers, a KLL sketch of their distribution; sketches of files merge to those of all.
    Files are told by their paths, so a file that is there must not change. Rows of files that are
    gone don't count.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _table(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _known(self, spark: SparkSession, name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(self._table(name))
        except AnalysisException:  # nothing was kept yet
            return None

    def update(self, df: DataFrame, name: str) -> list[str]:
        """Read the files of ``df``, a table of files, that the store doesn't have; their paths come back."""
        spark = df.sparkSession
        known = self._known(spark, name)
        held = {r.file for r in known.select("file").distinct().collect()} if known is not None else set()
        new = sorted(set(df.inputFiles()) - held)
        if new:
            self._facts(spark.read.schema(df.schema).parquet(*new)).write.mode("append").parquet(self._table(name))
        return new

    @staticmethod
    def _facts(df: DataFrame) -> DataFrame:
        fields = df.schema.fields
        own = df.select(F.input_file_name().alias("file"), *(_comparable(f).alias(f"v{i}") for i, f in enumerate(fields)))
        aggs, rows = [F.count("*").alias("n")], []
        for i, f in enumerate(fields):
            v, number = F.col(f"v{i}"), isinstance(f.dataType, NumericType)
            low, high = (x(v).cast("string") if f.dataType.typeName() != "binary" else F.lit(None).cast("string") for x in (F.min, F.max))
            counted = v if f.dataType.typeName() in ("byte", "short", "integer", "long", "string", "binary") or _is_text(f) else v.cast("string")
            counted = counted.cast("int") if f.dataType.typeName() in ("byte", "short") else counted
            aggs += [F.count(v).alias(f"set{i}"), low.alias(f"low{i}"), high.alias(f"high{i}"), F.hll_sketch_agg(counted, F.lit(14)).alias(f"hll{i}"),
                     (F.max(F.length(v)).cast("long") if _is_text(f) else F.lit(None).cast("long")).alias(f"longest{i}"),
                     (F.kll_sketch_agg_double(v.cast("double")) if number else F.lit(None).cast("binary")).alias(f"kll{i}")]
            rows.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"set{i}")).alias("n_null"),
                                 F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high"), F.col(f"longest{i}").alias("max_length"), F.col(f"hll{i}").alias("hll"), F.col(f"kll{i}").alias("kll")))
        return own.groupBy("file").agg(*aggs).select("file", F.inline(F.array(*rows)))

    def profile(self, df: DataFrame, name: str) -> DataFrame:
        """(table_name, column_name, type, n_rows, n_null, n_distinct, max_length, quartiles) of the files of ``df`` that the store has.

        n_distinct is an estimate (1 % standard error); quartiles are of numbers only. No row of the table is read.
        """
        spark = df.sparkSession
        known = self._known(spark, name)
        if known is None:
            raise ValueError(f"the store has nothing on {name}")
        there = spark.createDataFrame([(f,) for f in df.inputFiles()], "file string")
        merged = known.join(there, "file", "left_semi").groupBy("column_name", "type").agg(
            F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("n_distinct"),
            F.max("max_length").alias("max_length"), F.kll_merge_agg_double("kll").alias("kll"), F.max(F.col("kll").isNotNull()).alias("number"))
        some = F.col("number") & (F.col("n_null") < F.col("n_rows"))
        points = F.when(some, F.kll_sketch_get_quantile_double("kll", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
        return merged.select(F.lit(name).alias("table_name"), "column_name", "type", "n_rows", "n_null", "n_distinct", "max_length", points.alias("quartiles"))


def profile(model: RelationalModel) -> DataFrame:
    return reduce(DataFrame.unionByName, (profile_by_column(t.df, t.name) for t in model.tables.values()))


def check_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n_rows, n_distinct, n_null, holds): is the column set a key of the data?"""
    null = " or ".join(f"`{c}` is null" for c in columns)
    groups = df.groupBy(*columns).agg(F.count("*").alias("n"))
    out = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"),
                     F.coalesce(F.sum(F.when(F.expr(null), F.col("n")).otherwise(0)), F.lit(0)).alias("n_null"))
    return out.withColumn("holds", (F.col("n_rows") == F.col("n_distinct")) & (F.col("n_null") == 0))


def check_keys(model: RelationalModel) -> DataFrame:
    """Every declared primary key and unique set against the data."""
    out = [check_key(t.df, list(c)).select(F.lit(t.name).alias("table_name"), F.lit(",".join(c)).alias("key"), "*")
           for t in model.tables.values() for c in (*([t.pk] if t.pk else []), *t.uniques)]
    return reduce(DataFrame.unionByName, out)


def discover_unique(model: RelationalModel) -> DataFrame:
    """(table_name, column_name): single columns without nulls whose values are all distinct.

    One pass counts rows, nulls and, to a standard error of 5 %, distinct values; only columns that
    come to half of the rows at least, ten such errors below all, are counted exactly.
    """
    spark = next(iter(model.tables.values())).df.sparkSession
    out = [spark.createDataFrame([], "table_name string, column_name string")]
    for t in model.tables.values():
        plain = [f.name for f in t.df.schema if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
        aggs = [x for i, c in enumerate(plain) for x in (F.count(f"`{c}`").alias(f"c{i}"), F.approx_count_distinct(f"`{c}`", 0.05).alias(f"d{i}"))]
        facts = t.df.agg(F.count("*").alias("n"), *aggs).first()
        for i, c in enumerate(plain):
            if facts["n"] and facts[f"c{i}"] == facts["n"] and facts[f"d{i}"] >= 0.5 * facts["n"]:
                twice = t.df.groupBy(f"`{c}`").agg(F.count("*").alias("n")).agg(F.max("n").alias("most")).where("most = 1")
                out.append(twice.select(F.lit(t.name).alias("table_name"), F.lit(c).alias("column_name")))
    return reduce(DataFrame.unionByName, out)


def recommendations(model: RelationalModel, undecided: list[tuple[str, str]]) -> DataFrame:
    """(table_name, column_name, max_length, rule): a rule for each undecided column, from its profile."""
    facts = {}
    for name in {t for t, _ in undecided}:
        t: TableSpec = model.table(name)
        for r in profile_frame(t.df.select(*(c for n, c in undecided if n == name)), name).collect():
            facts[name, r.column_name] = r
    rows = []
    for name, c in sorted(undecided):
        r = facts[name, c]
        unique = (c,) in model.table(name).uniques and r.n_null == 0
        rows.append((name, c, r.max_length, recommend(c, unique, r.max_length)))
    spark = next(iter(model.tables.values())).df.sparkSession
    return spark.createDataFrame(rows, "table_name string, column_name string, max_length long, rule string")


def sensitive_summary(model: RelationalModel, classifier: Classifier) -> DataFrame:
    """(table_name, n_rows, n_masked, n_redacted, n_unreviewed): columns by what masking does to them, untouched tables last."""
    from .masking import rule_plan

    plan = rule_plan(model, classifier).groupBy("table_name").agg(
        *(F.sum(F.when(F.col("action") == a, 1).otherwise(0)).alias(f"n_{a}") for a in ("masked", "redacted", "unreviewed")))
    rows = reduce(DataFrame.unionByName, (t.df.agg(F.count("*").alias("n_rows")).select(F.lit(t.name).alias("table_name"), "n_rows") for t in model.tables.values()))
    return rows.join(plan, "table_name").orderBy((F.col("n_masked") + F.col("n_redacted") == 0), "table_name")
