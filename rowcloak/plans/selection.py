"""Queries on row selection, joins and the closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ForeignKey, RelationalModel, TableSpec
from ..operators.closure import child_keys, closure, keyset_counts, load_keys, parent_keys, preset_estimates, read_slice, root_keys, save_keys
from ..operators.integrity import edges, orphan_counts
from ..operators.slicing import partition_rollup, slice_summary
from ..scratch import scratch_path
from ..sources.indexes import build_indexes, open_indexes
from ..sources.tables import EVENTS_FK, STAR_FKS, full_model, logical_table, star_model

ROOT = "c_mktsegment = 'BUILDING' and c_acctbal > 9000"
SHOWN = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "part": "p_partkey", "events": "event_id"}


def _keys(model: RelationalModel, table: str, where: str) -> DataFrame:
    return root_keys(model, table, where, limit=None)


def _fk(child: str, parent: str) -> ForeignKey:
    return next(f for f in [*STAR_FKS, EVENTS_FK] if (f.child, f.parent) == (child, parent))


def root_where_limit(spark: SparkSession, d: str) -> DataFrame:
    return root_keys(star_model(spark, d), "customer", "c_acctbal > 0", limit=50)


def root_sample(spark, d):
    return root_keys(star_model(spark, d), "orders", limit=None, sample_percent=10)


def parent_keys_of_orders(spark, d):
    m = star_model(spark, d)
    return parent_keys(m, _fk("orders", "customer"), _keys(m, "orders", "o_totalprice > 100000"))


def parent_keys_unique_ref(spark, d):
    m = star_model(spark, d)
    named = m.table("orders").df.join(m.table("customer").df, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderstatus", "c_name")
    fk = ForeignKey("invoices", ("c_name",), "customer", ("c_name",))
    m = RelationalModel([TableSpec("invoices", named, ("o_orderkey",)), m.table("customer")], [fk])
    return parent_keys(m, fk, _keys(m, "invoices", "o_orderstatus = 'F'"))


def child_keys_of_customers(spark, d, limit=None):
    m = star_model(spark, d)
    return child_keys(m, _fk("orders", "customer"), _keys(m, "customer", "c_nationkey = 3"), limit)


def child_keys_capped(spark, d):
    return child_keys_of_customers(spark, d, 5)


def hot_parent_capped(spark, d):
    """Line items under one of two parents each, at most 700 of either: a parent's children lie in many tasks."""
    m = star_model(spark, d)
    items = m.table("lineitem").df.select("l_linestatus", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("item")).distinct()
    states = TableSpec("states", items.select("l_linestatus").distinct(), ("l_linestatus",))
    fk = ForeignKey("items", ("l_linestatus",), "states", ("l_linestatus",))
    m = RelationalModel([TableSpec("items", items, ("l_linestatus", "item")), states], [fk])
    return child_keys(m, fk, root_keys(m, "states", limit=None), 700)


def closure_indexed(spark, d):
    """The closure with the children of customers and orders taken from reverse indexes."""
    m, folder = star_model(spark, d), scratch_path(spark, "index")
    build_indexes(m, folder, [f for f in m.fks if f.parent in ("customer", "orders")], rows=20_000)
    keys = closure(m, "customer", _keys(m, "customer", ROOT), 1, child_limit=None, index=open_indexes(spark, m, folder))
    return keyset_counts(keys)


def closure_self(spark, d):
    """Customers that report to others of their own table, followed to the top."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") > 0, F.floor(F.col("c_custkey") / 2)).cast("long").alias("boss"))
    m = RelationalModel([TableSpec("customer", c, ("c_custkey",))], [ForeignKey("customer", ("boss",), "customer", ("c_custkey",))])
    return closure(m, "customer", _keys(m, "customer", "c_nationkey = 7"), 0)["customer"].select("c_custkey", "depth")


def composite_fk_parents(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    replies = turns.select(F.col("conv_id").alias("in_conv"), F.col("turn").alias("at"), (F.col("turn") - 1).alias("of_turn"))
    fk = ForeignKey("replies", ("in_conv", "of_turn"), "conversations", ("conv_id", "turn"))
    m = RelationalModel([TableSpec("conversations", turns, ("conv_id", "turn")), TableSpec("replies", replies, ("in_conv", "at"))], [fk])
    return parent_keys(m, fk, _keys(m, "replies", "at > 1"))


def virtual_key_when(spark, d):
    m = star_model(spark, d)
    fk = ForeignKey("events", ("user_id",), "customer", ("c_custkey",), when="event_type = 'purchase'", virtual=True)
    return parent_keys(m, fk, _keys(m, "events", "value > 10"))


def _closed(spark, d, depth, root="customer", where=ROOT):
    m = star_model(spark, d)
    return m, closure(m, root, _keys(m, root, where), depth, child_limit=None)


def closure_counts(depth):
    return lambda spark, d: keyset_counts(_closed(spark, d, depth)[1])


def closure_depths(spark, d):
    _, keys = _closed(spark, d, 1)
    out = [k.select(F.lit(t).alias("table_name"), F.col(SHOWN[t]).cast("long").alias("key"), F.col("depth").cast("long").alias("depth"))
           for t, k in keys.items() if t in SHOWN]
    return logical_table(out)


def closure_via(spark, d):
    """How many keys each relationship found."""
    _, keys = _closed(spark, d, 1)
    found = logical_table([k.select("depth", "via") for k in keys.values()])
    return found.groupBy("via").agg(F.count("*").alias("n_keys"), F.min("depth").cast("long").alias("min_depth"))


_HEADS = "SELECT n_nationkey, n_regionkey, (SELECT max(c_custkey) FROM customer WHERE c_nationkey % 24 = n_nationkey - 1 AND c_acctbal > 5000) AS head_customer FROM nation"


def closure_cycle(spark, d):
    """A cycle of nations and customers: a nation's head lives in another nation."""
    m = star_model(spark, d)
    heads = m.table("customer").df.where("c_acctbal > 5000").groupBy((F.col("c_nationkey") % 24 + 1).alias("n_nationkey")).agg(F.max("c_custkey").alias("head_customer"))
    nation = TableSpec("nation", m.table("nation").df.join(heads, "n_nationkey", "left"), ("n_nationkey",))
    m = RelationalModel([nation, m.table("customer")], [ForeignKey("nation", ("head_customer",), "customer", ("c_custkey",)), _fk("customer", "nation")])
    return keyset_counts(closure(m, "nation", _keys(m, "nation", "n_nationkey % 5 = 1"), 0))


def saved_keys(spark, d):
    """Key sets kept and loaded again."""
    _, keys = _closed(spark, d, 0)
    path = scratch_path(spark, "saved")
    save_keys(keys, path)
    return keyset_counts(load_keys(spark, path, list(keys)))


def presets(spark, d):
    return preset_estimates(star_model(spark, d), "customer", "c_acctbal > 0")


def slice_orders(spark, d):
    m, keys = _closed(spark, d, 1)
    return read_slice(m, keys["orders"], "orders")


def slice_lineitem(spark, d):
    m, keys = _closed(spark, d, 1, "orders", "o_totalprice > 450000")
    return read_slice(m, keys["lineitem"], "lineitem")


def summary_of_slice(spark, d):
    m, keys = _closed(spark, d, 1)
    return slice_summary(m, keys)


def all_orphans(spark, d):
    return orphan_counts(full_model(spark, d))


def all_edges(spark, d):
    return edges(full_model(spark, d)).withColumn("is_virtual", F.col("is_virtual").cast("string"))


def logical_events(spark, d):
    """Events split into one partition a type and read through one logical table again."""
    events = spark.read.parquet(f"{d}/events.parquet")
    parts = [events.where(c) for c in ("event_type = 'purchase'", "event_type <> 'purchase'", "event_type is null")]
    return logical_table(parts).select("event_id", "event_type", "value")


def rollup_of_partitions(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    parts = {"p1": ("events", events.where("value > 50")), "p2": ("events", events.where("not coalesce(value > 50, false)")), "o": ("orders", spark.read.parquet(f"{d}/orders.parquet"))}
    return partition_rollup(parts)


# (child, its SQL key, reference), (parent, its SQL key, referenced) of the star schema
_LINE = "l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|' || l_quantity || '|' || l_extendedprice || '|' || l_discount || '|' || l_tax || '|' || l_returnflag || '|' || l_linestatus || '|' || l_shipdate"
_KEY = {**SHOWN, "lineitem": _LINE}
_ORDER = ["lineitem", "events", "orders", "supplier", "part", "customer", "nation", "region"]  # children first


def closure_sql(depth: int, root: str = "customer", where: str = ROOT) -> str:
    """Common table expressions k{depth}_{table}: all keys found up to a depth."""
    ctes: list[str] = []
    fks = [*STAR_FKS, EVENTS_FK]
    for level in range(depth + 1):
        for t in _ORDER:
            parts = []
            if level == 0 and t == root:
                parts.append(f"SELECT {_KEY[t]} AS k FROM {t} WHERE {where}")
            if level:
                parts.append(f"SELECT k FROM k{level - 1}_{t}")
                parts += [f"SELECT {_KEY[t]} FROM {t} WHERE {f.columns[0]} IN (SELECT k FROM k{level - 1}_{f.parent})" for f in fks if f.child == t]
            parts += [f"SELECT {f.ref_columns[0]} FROM {t} WHERE {f.ref_columns[0]} IN (SELECT {f.columns[0]} FROM {f.child} WHERE {_KEY[f.child]} IN (SELECT k FROM k{level}_{f.child}))"
                      for f in fks if f.parent == t]
            ctes.append(f"k{level}_{t}(k) AS (" + (" UNION ".join(parts) or f"SELECT {_KEY[t]} AS k FROM {t} WHERE false") + ")")
    return "WITH " + ",\n".join(ctes)


def _counts_sql(depth: int) -> str:
    return closure_sql(depth) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_keys FROM k{depth}_{t}" for t in _ORDER) + ") WHERE n_keys > 0"


_DEPTHS = closure_sql(1) + " " + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, k::BIGINT AS key, CASE WHEN k IN (SELECT k FROM k0_{t}) THEN 0 ELSE 1 END::BIGINT AS depth FROM k1_{t}" for t in _ORDER if t in SHOWN)


def _orphans_sql(fk: ForeignKey) -> str:
    return f"SELECT '{fk.name}' AS fk, count(*) AS n_orphans FROM {fk.child} c WHERE c.{fk.columns[0]} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {fk.parent} p WHERE p.{fk.ref_columns[0]} = c.{fk.columns[0]})"


def _edges_sql(fk: ForeignKey) -> str:
    return f"SELECT '{fk.child}' AS child, '{fk.parent}' AS parent, '{fk.name}' AS fk, '{str(fk.virtual).lower()}' AS is_virtual, count({fk.columns[0]}) AS n_references FROM {fk.child}"


_ALL = [*STAR_FKS, EVENTS_FK, ForeignKey("labels", ("doc_id",), "documents", ("doc_id",))]

QUERIES = {
    "root_where_limit": (root_where_limit, "SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 50"),
    "root_sample": (root_sample, "SELECT o_orderkey FROM orders WHERE ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 10000 < 1000"),
    "parent_keys": (parent_keys_of_orders, "SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000"),
    "parent_keys_unique_ref": (parent_keys_unique_ref, "SELECT DISTINCT c_custkey FROM customer WHERE c_name IN (SELECT c.c_name FROM orders JOIN customer c ON o_custkey = c.c_custkey WHERE o_orderstatus = 'F')"),
    "child_keys": (child_keys_of_customers, "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3"),
    "child_keys_capped": (child_keys_capped, "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) <= 5"),
    "hot_parent_capped": (hot_parent_capped, """SELECT l_linestatus, item FROM (SELECT DISTINCT l_linestatus, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS item FROM lineitem)
        QUALIFY row_number() OVER (PARTITION BY l_linestatus ORDER BY item) <= 700"""),
    "closure_indexed": (closure_indexed, _counts_sql(1)),
    "closure_self": (closure_self, """WITH RECURSIVE w(k) AS (SELECT c_custkey FROM customer WHERE c_nationkey = 7
            UNION SELECT c.c_custkey FROM w JOIN customer c ON k > 0 AND c.c_custkey = k // 2) SELECT k AS c_custkey, 0 AS depth FROM w"""),
    "composite_fk_parents": (composite_fk_parents, "SELECT DISTINCT p.conv_id, p.turn FROM conversations p JOIN conversations r ON r.conv_id = p.conv_id AND r.turn - 1 = p.turn WHERE r.turn > 1"),
    "virtual_key_when": (virtual_key_when, "SELECT DISTINCT c_custkey FROM customer JOIN events ON user_id = c_custkey WHERE event_type = 'purchase' AND value > 10"),
    "closure_depth0": (closure_counts(0), _counts_sql(0)),
    "closure_depth1": (closure_counts(1), _counts_sql(1)),
    "closure_depth2": (closure_counts(2), _counts_sql(2)),
    "closure_depths": (closure_depths, _DEPTHS),
    "closure_via": (closure_via, closure_sql(1) + """, r AS (SELECT 'root' AS via, (SELECT count(*) FROM k0_customer) AS n_keys, 0 AS min_depth """
        + " ".join(f"UNION ALL SELECT '{_fk(c, p).name}', {f'(SELECT count(*) FROM k0_{p}) + ' if up else ''}(SELECT count(*) FROM k1_{c}) - (SELECT count(*) FROM k0_{c}), {0 if up else 1}"
                   for c, p, up in (("customer", "nation", True), ("nation", "region", True), ("supplier", "nation", False), ("orders", "customer", False), ("events", "customer", False)))
        + ") SELECT * FROM r WHERE n_keys > 0"),
    "closure_cycle": (closure_cycle, f"""WITH RECURSIVE h AS ({_HEADS}), w(t, k) AS (
            SELECT 'nation', n_nationkey FROM h WHERE n_nationkey % 5 = 1
            UNION (SELECT 'customer', head_customer FROM h, w WHERE t = 'nation' AND k = n_nationkey AND head_customer IS NOT NULL
                   UNION ALL SELECT 'nation', c_nationkey FROM customer, w WHERE t = 'customer' AND k = c_custkey))
        SELECT t AS table_name, count(*) AS n_keys FROM w GROUP BY 1"""),
    "saved_keys": (saved_keys, _counts_sql(0)),
    "preset_estimates": (presets, """WITH n AS (SELECT (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS roots, (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM orders) AS o,
            (SELECT count(*) FROM events) AS e, (SELECT count(*) FROM lineitem) AS l),
        p AS (SELECT unnest(['small', 'medium', 'large']) AS preset, unnest([1000, 10000, 100000]) AS most, unnest([1, 1, 2]) AS depth)
        SELECT preset, least(roots, most) AS root_rows, round(least(roots, most) * (1 + o / c + e / c + CASE WHEN depth > 1 THEN o / c * l / o ELSE 0 END))::BIGINT AS estimated_rows FROM n, p"""),
    "slice_orders": (slice_orders, closure_sql(1) + " SELECT * FROM orders WHERE o_orderkey IN (SELECT k FROM k1_orders)"),
    "slice_lineitem": (slice_lineitem, closure_sql(1, "orders", "o_totalprice > 450000") + f" SELECT * FROM lineitem WHERE {_LINE} IN (SELECT k FROM k1_lineitem)"),
    "slice_summary": (summary_of_slice, closure_sql(1) + ", r AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_source, (SELECT count(*) FROM k1_{t}) AS n_extracted, {int(t in ('region', 'nation', 'customer', 'supplier', 'part'))} AS n_masked_columns" for t in _ORDER)
        + ") SELECT * FROM r UNION ALL SELECT 'total', sum(n_source), sum(n_extracted), sum(n_masked_columns) FROM r"),
    "orphan_counts": (all_orphans, " UNION ALL ".join(map(_orphans_sql, _ALL))),
    "edges": (all_edges, " UNION ALL ".join(map(_edges_sql, _ALL))),
    "logical_events": (logical_events, "SELECT event_id, event_type, value FROM events"),
    "partition_rollup": (rollup_of_partitions, "SELECT 'events' AS table_name, count(*) AS n_rows FROM events UNION ALL SELECT 'orders', count(*) FROM orders"),
}
