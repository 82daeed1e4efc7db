"""Leak scans: every text column against every check, one pass over each table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, VariantType

from ..functions.detect import CHECKS, Check, matches, redact_sample
from ..model import RelationalModel, TableSpec

FINDINGS = "table_name string, column_name string, kind string, matches long, sample string"


class LeakFound(AssertionError):
    """A scan that had to be clean has findings."""


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (StringType, VariantType))]


def scan_frame(df: DataFrame, name: str, key: list[str], checks=CHECKS, ignore=(), sample: int | None = None, token_level: bool = False) -> DataFrame:
    """Findings of one DataFrame; the sample is that of the first match by ``key``.

    One pass: each check runs once on each cell, only hits go on to be counted. ``sample`` caps the
    matches for each column and check to the first by ``key``, so the count is exact up to the cap;
    every task keeps no more than so many of its own before they meet (up to Spark's limit for that,
    1,000).
    """
    columns = [c for c in text_columns(df) if not {f"{name}.{c}", c, f"{name.rpartition('.')[2]}.{c}"} & set(ignore)]
    if not columns or not checks:
        return df.sparkSession.createDataFrame([], FINDINGS)
    at = F.struct(*(F.col(k) for k in key)) if key else F.lit(0)

    def cell(c: str, check: Check) -> Column:
        text = F.col(c).cast("string")
        return F.struct(F.lit(c).alias("column_name"), F.lit(check.kind).alias("kind"), redact_sample(text).alias("sample"))

    hit = lambda c, check: matches(F.col(c).cast("string"), check, token_level)
    found = df.select(at.alias("at"), F.inline(F.array_compact(F.array(*(F.when(hit(c, k), cell(c, k)) for c in columns for k in checks)))))
    if sample:
        nth = F.row_number().over(Window.partitionBy("column_name", "kind").orderBy("at", "sample"))
        found = found.withColumn("_nth", nth).where(F.col("_nth") <= sample).drop("_nth")
    out = found.groupBy("column_name", "kind").agg(F.count("*").alias("matches"), F.min(F.struct("at", "sample")).alias("s"))
    return out.select(F.lit(name).alias("table_name"), "column_name", "kind", "matches", F.col("s.sample").alias("sample"))


def scan(model: RelationalModel, checks=CHECKS, ignore=(), sample: int | None = None, token_level: bool = False, tables: list[str] | None = None) -> DataFrame:
    """Findings of all logical tables, most matches first."""
    specs = [t for t in model.tables.values() if not t.partition_of and (tables is None or t.name in tables)]
    found = [scan_frame(t.df, t.name, list(t.pk) or t.df.columns[:1], checks, ignore, sample, token_level) for t in specs]
    return reduce(DataFrame.unionByName, found).orderBy(F.desc("matches"), "table_name", "column_name", "kind")


def is_clean(findings: DataFrame) -> bool:
    return findings.isEmpty()


def assert_clean(findings: DataFrame) -> None:
    if not is_clean(findings):
        raise LeakFound("; ".join(f"{r.table_name}.{r.column_name}: {r.matches} {r.kind}" for r in findings.limit(20).collect()))


def matching_rows(t: TableSpec, column: str, check: Check, token_level: bool = False) -> DataFrame:
    """The rows behind a finding: key and redacted sample."""
    text = F.col(column).cast("string")
    return t.df.where(matches(text, check, token_level)).select(*t.pk, redact_sample(text).alias("sample"))


def capped_rows(t: TableSpec, column: str, checks: list[Check], cap: int) -> DataFrame:
    """At most ``cap`` rows behind each check, the first by key."""
    text = F.col(column).cast("string")
    hits = F.array_compact(F.array(*(F.when(matches(text, c), F.lit(c.kind)) for c in checks)))
    rows = t.df.select(*t.pk, F.explode(hits).alias("kind"), redact_sample(text).alias("sample"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy(*t.pk))).where(F.col("_n") <= cap).drop("_n")


def canary_counts(model: RelationalModel, canaries: list[str]) -> DataFrame:
    """(table_name, n_rows): rows whose text holds any planted value."""
    def hit(df: DataFrame) -> Column:
        text = F.concat_ws("\n", *(F.col(c).cast("string") for c in text_columns(df)))
        return reduce(lambda a, b: a | b, (text.contains(c) for c in canaries), F.lit(False))

    out = [t.df.agg(F.sum(F.when(hit(t.df), 1).otherwise(0)).cast("long").alias("n_rows")).select(F.lit(t.name).alias("table_name"), F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"))
           for t in model.tables.values()]
    return reduce(DataFrame.unionByName, out)
