"""Queries on loads: cycles in waves, all-or-nothing writes, scripts, and the gate before them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import CHECKS
from ..functions.rules import mask
from ..model import ForeignKey, RelationalModel, TableSpec
from ..operators.integrity import assert_referential
from ..operators.loading import load_plan, unmet_references
from ..operators.masking import Classifier, rule_plan
from ..operators.scan import LeakFound, assert_clean, scan
from ..operators.slicing import slice_summary, sliced
from ..scratch import scratch_path
from ..sources.commits import read_images, read_tables
from ..sources.script import read_script
from ..sources.sinks import target_status, write_slice, write_sql, write_summaries
from ..sources.tables import full_model, star_model
from .checking import _COLUMNS, _HEADED, _headed, _slice, match_sql
from .masking import SEED
from .selection import _ORDER as ORDER, closure_sql


def _rings(spark, d) -> RelationalModel:
    """Two cycles that share a table: a nation's head customer and first supplier, and the nation of either."""
    m = star_model(spark, d, events=False)
    first = m.table("supplier").df.where("s_suppkey % 2 = 0").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("first_supplier"))
    nation = _headed(spark, d).join(first, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", "n_name", "head_customer", "first_supplier")
    pinned = lambda t, c: TableSpec(t, m.table(t).df, m.table(t).pk, not_null=frozenset({c}), sequences=m.table(t).pk)
    return RelationalModel([TableSpec("nation", nation, ("n_nationkey",)), pinned("customer", "c_nationkey"), pinned("supplier", "s_nationkey"), m.table("orders")], [
        ForeignKey("nation", ("head_customer",), "customer", ("c_custkey",)), ForeignKey("nation", ("first_supplier",), "supplier", ("s_suppkey",)),
        ForeignKey("customer", ("c_nationkey",), "nation", ("n_nationkey",)), ForeignKey("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
        ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",))])


_RINGS = f"SELECT h.*, (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 2 = 0) AS first_supplier FROM ({_HEADED}) h"


def _loaded_rings(spark, d) -> tuple[RelationalModel, str]:
    m, path = _rings(spark, d), scratch_path(spark, "rings")
    write_slice(m, {t: s.df for t, s in m.tables.items()}, path, source=d)
    return m, path


def cyclic_load(spark, d):
    """A cyclic slice loaded by waves and read back: its nations as they were."""
    m, path = _loaded_rings(spark, d)
    back = read_tables(spark, m, path)
    assert_referential(sliced(m, back))
    return back["nation"]


def cyclic_images(spark, d):
    """What of that load waits: the rows as inserted, and the values that were restored."""
    _, path = _loaded_rings(spark, d)
    images, later = read_images(spark, path)
    show = lambda df, part: df.select(F.lit(part).alias("part"), "n_nationkey", "head_customer", "first_supplier")
    return show(images["nation"], "image").unionByName(show(later["nation"], "deferred"))


def load_waves(spark, d):
    """The waves of that load, and what of them has no parent before it."""
    m = _rings(spark, d)
    return unmet_references(m, load_plan(m), {t: s.df for t, s in m.tables.items()})


def failed_write(spark, d):
    """A load whose last table fails leaves the target as it was."""
    m, path = star_model(spark, d, events=False), scratch_path(spark, "failed")
    write_slice(m, {t: m.table(t).df for t in ("region", "nation", "customer")}, path, source=d)
    broken = F.when(F.col("l_quantity") >= 0, F.raise_error(F.lit("broken")).cast("int"))
    bad = m.table("lineitem").df.withColumn("l_linenumber", broken.otherwise(F.col("l_linenumber").cast("int")))
    try:
        write_slice(m, {t: m.table(t).df for t in ("supplier", "part", "orders")} | {"lineitem": bad}, path, "append", source=d)
    except Exception as e:
        if "broken" not in str(e):
            raise
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in read_tables(spark, m, path).items()]
    return reduce(DataFrame.unionByName, counts)


def script_rows(spark, d):
    """A cyclic load's script, written by the data source and read back."""
    m, path = _rings(spark, d), scratch_path(spark, "script")
    write_sql(m, {t: s.df for t, s in m.tables.items()}, path)
    return read_script(spark, path)


def _tuples(table: str, key: str, cells: list[str], head: str, tail: str = ";", where: str = "true") -> str:
    """(statement_no, statement) of 500 rows each."""
    row = " || ', ' || ".join(f"coalesce({c}, 'NULL')" for c in cells)
    return (f"SELECT (rn - 1) // 500 AS statement_no, '{head}' || string_agg('(' || {row} || ')', ', ' ORDER BY rn) || '{tail}' AS statement "
            f"FROM (SELECT *, row_number() OVER (ORDER BY {key}) AS rn FROM {table} WHERE {where}) GROUP BY 1")


def _text(c: str) -> str:
    return f"chr(39) || replace({c}, chr(39), chr(39) || chr(39)) || chr(39)"


def _plain(*columns: str) -> list[str]:
    return [f"{c}::VARCHAR" for c in columns]


def _script_sql() -> str:
    names = lambda cs: ", ".join(f'"{c}"' for c in cs.split())
    insert = lambda t, cs: f'INSERT INTO "public"."{t}" ({names(cs)}) VALUES '
    day = "chr(39) || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || chr(39)"
    update = 'UPDATE "public"."nation" AS t SET "head_customer" = v."head_customer", "first_supplier" = v."first_supplier" FROM (VALUES '
    behind = ') AS v ("n_nationkey", "head_customer", "first_supplier") WHERE t."n_nationkey" = v."n_nationkey";'
    parts = [
        ("001-insert-nation", _tuples("rings", "n_nationkey", [*_plain("n_nationkey"), _text("n_name"), "'NULL'", "'NULL'"], insert("nation", "n_nationkey n_name head_customer first_supplier"))),
        ("002-insert-customer", _tuples("customer", "c_custkey", [*_plain("c_custkey"), _text("c_name"), *_plain("c_nationkey", "c_acctbal"), _text("c_mktsegment")], insert("customer", _COLUMNS["customer"]))),
        ("003-insert-supplier", _tuples("supplier", "s_suppkey", [*_plain("s_suppkey"), _text("s_name"), *_plain("s_nationkey", "s_acctbal")], insert("supplier", _COLUMNS["supplier"]))),
        ("004-insert-orders", _tuples("orders", "o_orderkey", [*_plain("o_orderkey", "o_custkey"), _text("o_orderstatus"), *_plain("o_totalprice"), day, _text("o_orderpriority")], insert("orders", _COLUMNS["orders"]))),
        ("005-update-nation", _tuples("rings", "n_nationkey", _plain("n_nationkey", "head_customer", "first_supplier"), update, behind, "head_customer IS NOT NULL OR first_supplier IS NOT NULL"))]
    reset = lambda i, t, c: (f"SELECT '006-sequences' AS section, {i} AS statement_no, 'SELECT setval(pg_get_serial_sequence(''\"public\".\"{t}\"'', ''{c}''), "  # noqa: E731
                             f"COALESCE(MAX(\"{c}\"), 1), MAX(\"{c}\") IS NOT NULL) FROM \"public\".\"{t}\";' AS statement")
    fixed = ["SELECT '000-begin', 0, 'BEGIN;'", reset(0, "customer", "c_custkey"), reset(1, "supplier", "s_suppkey"), "SELECT '999-commit', 0, 'COMMIT;'"]
    return f"WITH rings AS ({_RINGS}) " + " UNION ALL ".join([f"SELECT '{name}' AS section, statement_no, statement FROM ({sql})" for name, sql in parts] + fixed)


def metadata_files(spark, d):
    """A slice's summary and rules as CSV, read back."""
    m, keys, _ = _slice(spark, d, 0)
    path = scratch_path(spark, "summaries")
    write_summaries(slice_summary(m, keys), rule_plan(m, Classifier()).select("table_name", "column_name", "rule"), path)
    tables = spark.read.schema("table_name string, n_source long, n_extracted long, n_masked_columns long").csv(f"{path}/tables", header=True)
    rules = spark.read.schema("table_name string, column_name string, rule string").csv(f"{path}/rules", header=True)
    ruled = rules.groupBy("table_name").agg(F.count("*").alias("n_rules"))
    return tables.join(ruled, "table_name", "left").fillna(0, ["n_rules"])


def gated_slice(spark, d):
    """A job that publishes a slice only if its gate lets it: with a leak it is refused, masked it passes."""
    star, path = star_model(spark, d, events=False), scratch_path(spark, "gated")
    texts = full_model(spark, d).table("documents").df.select("doc_id", "text")
    m = RelationalModel([TableSpec("notes", texts, ("doc_id",)), *star.tables.values()], star.fks)
    masked = texts.withColumn("text", mask(F.col("text"), "redact", texts.schema["text"].dataType, SEED))
    out = []
    for job, notes in (("open", texts), ("masked", masked)):
        frames = {"notes": notes, "nation": m.table("nation").df, "region": m.table("region").df}
        cut = sliced(m, frames)
        try:
            assert_referential(cut)
            assert_clean(scan(cut))
            write_slice(m, frames, f"{path}-{job}", source=d)
        except LeakFound:
            pass
        out.append(target_status(spark, cut, f"{path}-{job}").select(F.lit(job).alias("job"), "table_name", F.col("is_there").cast("string").alias("is_there")))
    return reduce(DataFrame.unionByName, out)


QUERIES = {
    "cyclic_load": (cyclic_load, _RINGS),
    "cyclic_images": (cyclic_images, f"""WITH r AS ({_RINGS}) SELECT 'image' AS part, n_nationkey, NULL::BIGINT AS head_customer, NULL::BIGINT AS first_supplier FROM r
        UNION ALL SELECT 'deferred', n_nationkey, head_customer, first_supplier FROM r WHERE head_customer IS NOT NULL OR first_supplier IS NOT NULL"""),
    "load_waves": (load_waves, """SELECT wave, table_name, fk, 0 AS n_unmet FROM (VALUES (0, 'nation', 'nation(first_supplier)->supplier(s_suppkey)'), (0, 'nation', 'nation(head_customer)->customer(c_custkey)'),
        (1, 'customer', 'customer(c_nationkey)->nation(n_nationkey)'), (1, 'supplier', 'supplier(s_nationkey)->nation(n_nationkey)')) AS v(wave, table_name, fk)
        UNION ALL SELECT 2, 'orders', 'orders(o_custkey)->customer(c_custkey)', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"""),
    "failed_write": (failed_write, " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("region", "nation", "customer"))),
    "script_rows": (script_rows, _script_sql()),
    "metadata_files": (metadata_files, closure_sql(0) + ", r AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_source, (SELECT count(*) FROM k0_{t}) AS n_extracted, {int(t in ('region', 'nation', 'customer', 'supplier', 'part'))} AS n_masked_columns, {len(_COLUMNS[t].split())} AS n_rules" for t in ORDER)
        + ") SELECT * FROM r UNION ALL SELECT 'total', sum(n_source)::BIGINT, sum(n_extracted)::BIGINT, sum(n_masked_columns)::BIGINT, 0 FROM r"),
    "gated_slice": (gated_slice, "SELECT j.job, t.table_name, (j.job = 'masked' OR NOT EXISTS (SELECT 1 FROM documents WHERE " + " OR ".join(match_sql(c) for c in CHECKS) + "))::VARCHAR AS is_there "
                    "FROM (VALUES ('open'), ('masked')) AS j(job), (VALUES ('notes'), ('nation'), ('region')) AS t(table_name)"),
}
