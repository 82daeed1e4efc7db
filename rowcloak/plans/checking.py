"""Queries on leak scans, integrity, profiles, sinks and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import CHECKS, custom_checks, luhn, redact_sample
from ..functions.literals import sql_literal
from ..functions.rules import mask
from ..model import ForeignKey, RelationalModel, TableSpec
from ..operators.closure import closure, read_slice, root_keys
from ..operators.integrity import break_candidates, break_cycle, inclusion_profile, orphan_counts, restore_cycle, soft_keys, suggest_root
from ..operators.masking import Classifier, rule_plan
from ..operators.profile import ProfileStore, check_keys, discover_unique, profile
from ..operators.scan import canary_counts, matching_rows, scan, scan_frame
from ..operators.slicing import slice_model, slice_summary, sliced
from ..scratch import scratch_path
from ..sources.commits import read_tables
from ..sources.script import insert_statements
from ..sources.sinks import each_table, next_key_values, target_status, write_slice, write_summaries
from ..sources.tables import EVENTS_FK, STAR_FKS, full_model, load_tables, star_model, STAR, TEXTS
from ..streaming.streams import latest_findings, mask_stream, running_scan, scan_stream
from .masking import H, SEED, SQL as MASK_SQL
from .selection import _LINE as LINE, _ORDER as ORDER, ROOT, SHOWN, closure_sql

LUHN_SQL = """(len(r) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(r), i::INT, 1)::INT
    ELSE substr(reverse(r), i::INT, 1)::INT * 2 // 10 + substr(reverse(r), i::INT, 1)::INT * 2 % 10 END)) % 10 = 0)"""


def match_sql(check, col: str = "text") -> str:
    re2 = lambda p: p.replace("'", "''")
    out = f"regexp_matches({col}, '{re2(check.include)}')"
    if check.exclude:
        out += f" AND NOT regexp_matches({col}, '{re2(check.exclude)}')"
    if check.luhn:
        out += f" AND len(list_filter(regexp_extract_all({col}, '[0-9]{{13,19}}'), lambda r: {LUHN_SQL})) > 0"
    return f"coalesce({out}, false)"


def sample_sql(col: str = "text") -> str:
    t = f"regexp_replace(regexp_replace(replace({col}, chr(10), ' '), '^\\s+', ''), '\\s+$', '')"
    return f"CASE WHEN length({t}) <= 6 THEN repeat('*', length({t})) ELSE substr({t}, 1, 3) || repeat('*', least(length({t}) - 6, 12)) || right({t}, 3) END"


CUSTOM = custom_checks([("license", r"MIT License"), ("skipped", "")])


#: What a third of the documents get at their end, for detectors that the given texts have nothing for.
_ADDED = {"secret token": "concat(' AKIA', upper(substr(md5(cast(doc_id as string)), 1, 16)))",
          "national id": "concat(' ', lpad(cast(doc_id % 1000 as string), 3, '0'), '-', lpad(cast(doc_id % 100 as string), 2, '0'), '-', lpad(cast(doc_id % 10000 as string), 4, '0'), '.')"}


def _text_of(kind: str, sql: bool = False) -> str:
    """The scanned text, in Spark's or the other SQL."""
    if kind not in _ADDED:
        return "text"
    added = _ADDED[kind].replace("cast(doc_id as string)", "doc_id::VARCHAR") if sql else _ADDED[kind]
    return f"(case when doc_id % 3 = 0 then concat(coalesce(text, ''), {added}) else text end)"


def scan_kind(check):
    def run(spark, d):
        t = full_model(spark, d).table("documents")
        return matching_rows(TableSpec("documents", t.df.withColumn("text", F.expr(_text_of(check.kind))), t.pk), "text", check)

    return run


def scan_findings(spark, d):
    return scan(full_model(spark, d), [*CHECKS, *CUSTOM], ignore=["documents.source"])


_SCANNED = [(t, c, k) for t, c, k in (
    ("documents", "text", "doc_id"), ("documents", "lang", "doc_id"), ("pages", "url", "page_id"), ("pages", "html", "page_id"), ("benchmark", "text", "item_id"),
    ("conversations", "role", "(conv_id, turn)"), ("conversations", "text", "(conv_id, turn)"), ("customer", "c_name", "c_custkey"), ("customer", "c_mktsegment", "c_custkey"),
    ("nation", "n_name", "n_nationkey"), ("region", "r_name", "r_regionkey"), ("supplier", "s_name", "s_suppkey"), ("part", "p_name", "p_partkey"), ("part", "p_brand", "p_partkey"),
    ("part", "p_type", "p_partkey"), ("orders", "o_orderstatus", "o_orderkey"), ("orders", "o_orderpriority", "o_orderkey"), ("events", "event_type", "event_id"), ("events", "props", "event_id"))]


def _finding_sql(t, c, k, check) -> str:
    hit = match_sql(check, c)
    return (f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{check.kind}' AS kind, count(*) FILTER ({hit}) AS matches, "
            f"arg_min({sample_sql(c)}, {k.replace('(', 'struct_pack(a := ').replace(', turn', ', b := turn') if '(' in k else k}) FILTER ({hit}) AS sample FROM {t}")


def redact_samples(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", redact_sample(F.col("text")).alias("sample"))


def luhn_numbers(spark, d):
    digits = F.lpad((F.col("o_orderkey") * 7919).cast("string"), 16, "4")
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", luhn(digits).cast("string").alias("valid"))


_SUBSTITUTES = ("email", "phone", "ip", "govid", "secret", "address", "name", "first_name", "last_name")


def scan_masked(spark, d):
    """Every rule's substitutes of every customer against every check.

    Nothing is found but government ids, which are hexadecimal: one of digits alone that begins
    with 00 reads like an international phone number.
    """
    df = spark.read.parquet(f"{d}/customer.parquet")
    out = df.select("c_custkey", *(mask(F.col("c_name"), r, df.schema["c_name"].dataType, SEED).alias(f"by_{r}") for r in _SUBSTITUTES))
    return scan_frame(out, "masked", ["c_custkey"])


def canaries(spark, d):
    return canary_counts(full_model(spark, d), ["Customer#00", "MIT License"])


def _headed(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 5000").groupBy("c_nationkey").agg(F.min("c_custkey").alias("head_customer"))
    n = spark.read.parquet(f"{d}/nation.parquet")
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") < 4, F.col("head_customer")).alias("head_customer"))


_HEADED = "SELECT n_nationkey, n_name, CASE WHEN n_regionkey < 4 THEN (SELECT min(c_custkey) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 5000) END AS head_customer FROM nation"


def break_image(spark, d):
    return break_cycle(_headed(spark, d), ["n_nationkey"], ["head_customer"])[0]


def break_deferred(spark, d):
    return break_cycle(_headed(spark, d), ["n_nationkey"], ["head_customer"])[1]


def restored(spark, d):
    return restore_cycle(*break_cycle(_headed(spark, d), ["n_nationkey"], ["head_customer"]), ["n_nationkey"], ["head_customer"])


def soft(spark, d):
    """References that nobody declared: orders under another name for their customer, events with theirs."""
    m = load_tables(spark, d, STAR | TEXTS, STAR_FKS)
    customers = m.table("customer").df.where("c_custkey % 10 < 7")
    orders = m.table("orders").df.select("o_orderkey", F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("customer_type"))
    extra = [TableSpec("customers", customers, ("c_custkey",)), TableSpec("bought", orders, ("o_orderkey",))]
    return soft_keys(RelationalModel([*(t for t in m.tables.values() if t.name != "customer"), *extra]))


def inclusion(spark, d):
    return inclusion_profile(star_model(spark, d), "events", "user_id", "customer", "c_custkey", by="event_type")


def roots(spark, d):
    return suggest_root(full_model(spark, d))


def profiled(spark, d):
    return profile(star_model(spark, d)).select("table_name", "column_name", "n_rows", "n_null", "n_distinct", "max_length")


def stored_profile(spark, d):
    """A table's profile from sketches: half of its files first, then the others, of which only those are read."""
    path, store = scratch_path(spark, "orders"), ProfileStore(scratch_path(spark, "profiles"))
    orders = spark.read.parquet(f"{d}/orders.parquet")
    orders.where("o_orderkey % 2 = 0").repartition(3).write.parquet(path)
    first = store.update(spark.read.parquet(path), "orders")
    orders.where("o_orderkey % 2 <> 0").repartition(2).write.mode("append").parquet(path)
    second = store.update(spark.read.parquet(path), "orders")
    if set(first) & set(second) or store.update(spark.read.parquet(path), "orders"):
        raise AssertionError("files were read twice")
    exact = {c: F.count_distinct(c).alias(c) for c in orders.columns}
    truth = orders.agg(*exact.values()).select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("truth")) for c in exact))))
    got = store.profile(spark.read.parquet(path), "orders").join(truth, "column_name")
    near = F.abs(F.col("n_distinct") - F.col("truth")) <= 1 + 0.05 * F.col("truth")
    return got.select("table_name", "column_name", "type", "n_rows", "n_null", "max_length", near.cast("string").alias("near"))


_STRINGS = {"r_name", "n_name", "c_name", "c_mktsegment", "s_name", "p_name", "p_brand", "p_type", "o_orderstatus", "o_orderpriority", "l_returnflag", "l_linestatus", "event_type", "props"}
_COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props"}


def _profile_sql(where: str = "") -> str:
    one = lambda t, c: (f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, "  # noqa: E731
                        f"count(DISTINCT {c}) AS n_distinct, {f'max(length({c}))' if c in _STRINGS else 'NULL::BIGINT'} AS max_length FROM {t}")
    return " UNION ALL ".join(one(t, c) for t, cs in _COLUMNS.items() for c in cs.split())


def keys_checked(spark, d):
    return check_keys(full_model(spark, d)).withColumn("holds", F.col("holds").cast("string"))


_KEYS = [(t, s["pk"]) for t, s in (STAR | TEXTS).items() if s.get("pk")] + [("customer", ("c_name",))]


def uniques(spark, d):
    return discover_unique(star_model(spark, d))


def insert_sql(spark, d):
    m = star_model(spark, d)
    return insert_statements(m.table("orders").df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"), m.table("orders"))


_INSERT = """SELECT (rn - 1) // 500 AS statement_no, 'INSERT INTO "public"."orders" ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate") VALUES '
    || string_agg('(' || o_orderkey || ', ' || o_custkey || ', ''' || o_orderstatus || ''', ''' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || ''')', ', ' ORDER BY rn) || ';' AS statement
    FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1"""


def literals(spark, d):
    df = spark.read.parquet(f"{d}/events.parquet")
    df = df.withColumn("flag", F.col("value") > 50).withColumn("raw", F.col("event_type").cast("binary")).withColumn("odd", F.concat(F.lit("it's "), F.col("props")))
    return df.select("event_id", *(sql_literal(F.col(c), df.schema[c].dataType).alias(f"lit_{c}") for c in ("user_id", "event_type", "ts", "flag", "raw", "odd")))


def next_keys(spark, d):
    specs = {"orders": STAR["orders"] | {"sequences": ("o_orderkey",)}, "customer": STAR["customer"] | {"sequences": ("c_custkey",)}}
    m = load_tables(spark, d, specs)
    empty = TableSpec("part", spark.read.parquet(f"{d}/part.parquet").where("p_size < 0"), ("p_partkey",), sequences=("p_partkey",))
    return next_key_values(RelationalModel([*m.tables.values(), empty])).withColumn("is_called", F.col("is_called").cast("string"))


def _slice(spark, d, depth: int):
    m = star_model(spark, d)
    keys = closure(m, "customer", root_keys(m, "customer", ROOT, limit=None), depth, child_limit=None)
    return m, keys, {t: read_slice(m, k, t) for t, k in keys.items()}


def written_status(spark, d):
    """The slice of some customers, and an empty table with it, written and looked at."""
    m, _, frames = _slice(spark, d, 1)
    path = scratch_path(spark, "slice")
    write_slice(m, frames | {"part": m.table("part").df.where("p_size < 0")}, path, source=d)
    return target_status(spark, m, path).withColumns({c: F.col(c).cast("string") for c in ("is_there", "has_rows")})


def written_orphans(spark, d):
    """A written slice has its parents: no orphan among the tables it has."""
    m = star_model(spark, d, events=False)
    path = scratch_path(spark, "slice")
    frames = {t: m.table(t).df for t in ("region", "nation", "customer", "orders")}
    write_slice(m, frames, path, source=d)
    return orphan_counts(sliced(m, read_tables(spark, m, path)))


def written_append(spark, d):
    """Orders written in two parts, the second one added to the first."""
    m = star_model(spark, d, events=False)
    path = scratch_path(spark, "slice")
    for mode, part in (("errorifexists", "o_orderkey % 2 = 0"), ("append", "o_orderkey % 2 <> 0")):
        write_slice(m, {"orders": m.table("orders").df.where(part)}, path, mode, source=d)
    return read_tables(spark, m, path)["orders"].groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"), F.sum("o_orderkey").alias("keys"))


def written_summaries(spark, d):
    """The metadata of a slice, written and read again."""
    m, keys, _ = _slice(spark, d, 0)
    path = scratch_path(spark, "summaries")
    write_summaries(slice_summary(m, keys), rule_plan(m, Classifier()).select("table_name", "column_name", "rule"), path)
    return spark.read.schema("table_name string, n_source long, n_extracted long, n_masked_columns long").json(f"{path}/summary")


def sink_rows(spark, d):
    """A sink of one's own gets every table of a slice, parents first."""
    m, _, frames = _slice(spark, d, 0)
    path = scratch_path(spark, "sink")
    each_table(m, frames, lambda t, df: df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows").write.mode("append").parquet(path))
    return spark.read.parquet(path)


def cycle_breaks(spark, d):
    """A nation's head customer and a customer's nation make a cycle; the head may be null."""
    nation, customer = TableSpec("nation", _headed(spark, d), ("n_nationkey",)), star_model(spark, d).table("customer")
    customer = TableSpec("customer", customer.df, customer.pk, not_null=frozenset({"c_nationkey"}))
    m = RelationalModel([nation, customer], [ForeignKey("nation", ("head_customer",), "customer", ("c_custkey",)), ForeignKey("customer", ("c_nationkey",), "nation", ("n_nationkey",))])
    return break_candidates(m).select("table_name", F.col("columns")[0].alias("column_name"), "n_deferred")


def end_to_end(spark, d):
    """The whole job: root rows, closure, masking, a written slice, and on that its rows, findings and orphans."""
    m = star_model(spark, d)
    ruled = Classifier(dict.fromkeys(("p_brand", "p_type", "c_mktsegment", "o_orderstatus", "o_orderpriority", "l_returnflag", "l_linestatus", "event_type"), "keep") | {"events.props": "redact", "customer.c_name": "secret"})
    frames = slice_model(m, "orders", SEED, where="o_totalprice > 450000", limit=None, child_limit=None, classifier=ruled)
    path = scratch_path(spark, "job")
    write_slice(m, frames, path, source=d)
    back = sliced(m, read_tables(spark, m, path))
    rows = reduce(DataFrame.unionByName, (t.df.agg(F.count("*").alias("n_rows")).select(F.lit(t.name).alias("table_name"), "n_rows") for t in back.tables.values()))
    leaks = scan(back).groupBy("table_name").agg(F.sum("matches").alias("n_findings"))
    lost = orphan_counts(back).groupBy(F.regexp_extract("fk", r"^([^(]*)", 1).alias("table_name")).agg(F.sum("n_orphans").alias("n_orphans"))
    return rows.join(leaks, "table_name", "left").join(lost, "table_name", "left").fillna(0, ["n_findings", "n_orphans"])


#: The text columns of a slice as end_to_end masks them, but for redacted ones and the names of word lists, which hold nothing a check looks for.
_MASKED = {t: cs.split() for t, cs in {"orders": "o_orderstatus o_orderpriority", "lineitem": "l_returnflag l_linestatus", "part": "p_brand p_type", "events": "event_type"}.items()} | {
    "customer": ["c_mktsegment", f"(CASE WHEN c_custkey = (SELECT min(k) FROM k1_customer) THEN 'REDACTED' ELSE 'REDACTED-' || substr({H('c_name', 1)}, 1, 12) END)"]}


def _end_to_end_sql() -> str:
    """Rows, findings and orphans of a slice. A masked customer may read like an international phone number, as 00 and digits."""
    def one(t: str) -> str:
        key = LINE if t == "lineitem" else SHOWN[t]
        hits = [f"count(*) FILTER ({match_sql(c, col)})" for col in _MASKED.get(t, []) for c in CHECKS]
        lost = [f"count(*) FILTER ({f.columns[0]} IS NOT NULL AND EXISTS (FROM k1_{f.parent}) AND {f.columns[0]} NOT IN (SELECT k FROM k1_{f.parent}))" for f in [*STAR_FKS, EVENTS_FK] if f.child == t]
        return f"SELECT '{t}' AS table_name, count(*) AS n_rows, {' + '.join(hits) or 0} AS n_findings, {' + '.join(lost) or 0} AS n_orphans FROM {t} WHERE {key} IN (SELECT k FROM k1_{t})"

    return closure_sql(1, "orders", "o_totalprice > 450000") + " SELECT * FROM (" + " UNION ALL ".join(map(one, ORDER)) + ") WHERE n_rows > 0"


def scan_capped(spark, d):
    """The scan of the documents, at most three matches for each column and check."""
    t = full_model(spark, d).table("documents")
    return scan_frame(t.df, "documents", ["doc_id"], sample=3).drop("sample")


def _run(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def stream_mask(spark, d):
    path, schema = scratch_path(spark, "stream"), spark.read.parquet(f"{d}/customer.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/customer.parquet*")
    _run(mask_stream(stream, {"c_name": "email", "c_mktsegment": "secret"}, SEED).writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state"))
    return spark.read.schema(schema).parquet(path)


def stream_scan(spark, d):
    path, schema = scratch_path(spark, "findings"), spark.read.parquet(f"{d}/documents.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*").select("doc_id", "text")
    _run(scan_stream(stream, "documents", ["doc_id"], path).option("checkpointLocation", f"{path}-state"))
    found = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return found.groupBy("table_name", "column_name", "kind").agg(F.sum("matches").alias("matches"))


def stream_running(spark, d):
    """Findings of a stream so far, after three batches."""
    path, source = scratch_path(spark, "running"), scratch_path(spark, "three")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    a_batch = -(-docs.rdd.getNumPartitions() // 3)  # files, so that no task holds more of the table than one of its scan does
    docs.repartition(3 * a_batch).write.parquet(source)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", a_batch).parquet(source)
    _run(running_scan(stream, "documents", ["doc_id"], path).option("checkpointLocation", f"{path}-state"))
    return latest_findings(spark, path)


QUERIES = {f"scan_{check.kind.replace(' ', '_')}": (scan_kind(check), f"WITH d AS (SELECT doc_id, {_text_of(check.kind, True)} AS text FROM documents) SELECT doc_id, {sample_sql()} AS sample FROM d WHERE {match_sql(check)}") for check in [*CHECKS, *CUSTOM]} | {
    "scan_capped": (scan_capped, "SELECT table_name, column_name, kind, least(matches, 3) AS matches FROM (" + " UNION ALL ".join(_finding_sql("documents", c, "doc_id", check) for c in ("text", "lang", "source") for check in CHECKS) + ") WHERE matches > 0"),
    "written_append": (written_append, "SELECT o_orderstatus, count(*) AS n_orders, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1"),
    "written_summaries": (written_summaries, closure_sql(0) + ", r AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_source, (SELECT count(*) FROM k0_{t}) AS n_extracted, {int(t in ('region', 'nation', 'customer', 'supplier', 'part'))} AS n_masked_columns" for t in ORDER)
        + ") SELECT * FROM r UNION ALL SELECT 'total', sum(n_source)::BIGINT, sum(n_extracted)::BIGINT, sum(n_masked_columns)::BIGINT FROM r"),
    "sink_rows": (sink_rows, closure_sql(0) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM k0_{t}" for t in ORDER) + ") WHERE n_rows > 0"),
    "cycle_breaks": (cycle_breaks, f"SELECT 'nation' AS table_name, 'head_customer' AS column_name, count(head_customer) AS n_deferred FROM ({_HEADED})"),
    "slice_end_to_end": (end_to_end, _end_to_end_sql()),
    "scan_findings": (scan_findings, "SELECT * FROM (" + " UNION ALL ".join(_finding_sql(t, c, k, check) for t, c, k in _SCANNED for check in [*CHECKS, *CUSTOM]) + ") WHERE matches > 0"),
    "redact_samples": (redact_samples, f"SELECT doc_id, {sample_sql()} AS sample FROM documents"),
    "luhn": (luhn_numbers, f"SELECT o_orderkey, (WITH x AS (SELECT lpad((o_orderkey * 7919)::VARCHAR, 16, '4') AS r) SELECT {LUHN_SQL} FROM x)::VARCHAR AS valid FROM orders"),
    "scan_masked_clean": (scan_masked, "WITH masked AS (SELECT c_custkey, " + ", ".join(f"{MASK_SQL[r]} AS by_{r}" for r in _SUBSTITUTES) + " FROM customer) SELECT * FROM ("
                          + " UNION ALL ".join(_finding_sql("masked", f"by_{r}", "c_custkey", c) for r in _SUBSTITUTES for c in CHECKS) + ") WHERE matches > 0"),
    "canary_counts": (canaries, " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) FILTER (" + (" OR ".join(f"contains({c}, '{x}')" for c in cs for x in ("Customer#00", "MIT License")) or "false") + f") AS n_rows FROM {t}"
        for t, cs in {t: [c for n, c, _ in [*_SCANNED, ("documents", "source", ""), ("lineitem", "l_returnflag", "")] if n == t] for t in (STAR | TEXTS)}.items())),
    "break_image": (break_image, f"SELECT n_nationkey, n_name, NULL::BIGINT AS head_customer FROM ({_HEADED})"),
    "break_deferred": (break_deferred, f"SELECT n_nationkey, head_customer FROM ({_HEADED}) WHERE head_customer IS NOT NULL"),
    "restore_cycle": (restored, _HEADED),
    "soft_keys": (soft, """SELECT 'events' AS table_name, 'user_id' AS column_name, NULL::VARCHAR AS guess, 'event_type' AS type_column, NULL::DOUBLE AS inclusion WHERE false
        UNION ALL SELECT 'events', 'user_id', NULL, NULL, NULL
        UNION ALL SELECT 'bought', 'customer_id', 'customers', 'customer_type', count(DISTINCT CASE WHEN o_custkey % 10 < 7 AND o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey END) / count(DISTINCT o_custkey) FROM orders"""),
    "inclusion_profile": (inclusion, "SELECT event_type AS discriminator, count(DISTINCT user_id) AS n_distinct, count(DISTINCT CASE WHEN user_id IN (SELECT c_custkey FROM customer) THEN user_id END) AS n_contained, count(DISTINCT CASE WHEN user_id IN (SELECT c_custkey FROM customer) THEN user_id END) / count(DISTINCT user_id) AS ratio FROM events WHERE user_id IS NOT NULL GROUP BY 1"),
    "suggest_root": (roots, " UNION ALL ".join(f"SELECT '{t}' AS table_name, {dict(region=1, nation=2, customer=102, supplier=1, part=1, orders=1, documents=1).get(t, 0)}::BIGINT AS score, count(*) AS n_rows FROM {t}" for t in (STAR | TEXTS))),
    "profile_columns": (profiled, _profile_sql()),
    "stored_profile": (stored_profile, " UNION ALL ".join(
        f"SELECT 'orders' AS table_name, '{c}' AS column_name, '{k}' AS type, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, {f'max(length({c}))' if c in _STRINGS else 'NULL::BIGINT'} AS max_length, 'true' AS near FROM orders"
        for c, k in zip(_COLUMNS["orders"].split(), ("bigint", "bigint", "string", "double", "timestamp_ntz", "string")))),
    "stream_running": (stream_running, "SELECT table_name, column_name, kind, matches, sample FROM (" + " UNION ALL ".join(_finding_sql("documents", "text", "doc_id", c) for c in CHECKS) + ") WHERE matches > 0"),
    "check_keys": (keys_checked, " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{','.join(k)}' AS key, sum(n)::BIGINT AS n_rows, count(*) AS n_distinct, coalesce(sum(n) FILTER ({' OR '.join(f'{c} IS NULL' for c in k)}), 0)::BIGINT AS n_null, (sum(n) = count(*) AND coalesce(sum(n) FILTER ({' OR '.join(f'{c} IS NULL' for c in k)}), 0) = 0)::VARCHAR AS holds FROM (SELECT {', '.join(k)}, count(*) AS n FROM {t} GROUP BY ALL)"
        for t, k in _KEYS)),
    "discover_unique": (uniques, f"SELECT table_name, column_name FROM ({_profile_sql()}) WHERE n_rows > 0 AND n_null = 0 AND n_distinct = n_rows"),
    "insert_sql": (insert_sql, _INSERT),
    "sql_literals": (literals, """SELECT event_id, user_id::VARCHAR AS lit_user_id, '''' || event_type || '''' AS lit_event_type, '''' || regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z''' AS lit_ts,
        upper((value > 50)::VARCHAR) AS lit_flag, '''\\x' || lower(hex(event_type)) || '''::bytea' AS lit_raw, '''it''''s ' || props || '''' AS lit_odd FROM events"""),
    "next_key_values": (next_keys, "SELECT 'orders' AS table_name, 'o_orderkey' AS column_name, max(o_orderkey) AS value, 'true' AS is_called FROM orders UNION ALL SELECT 'customer', 'c_custkey', max(c_custkey), 'true' FROM customer UNION ALL SELECT 'part', 'p_partkey', 1, 'false'"),
    "target_status": (written_status, closure_sql(1) + " " + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {'true' if t == 'part' else f'EXISTS (FROM k1_{t})'}::VARCHAR AS is_there, EXISTS (FROM k1_{t})::VARCHAR AS has_rows" for t in ORDER)),
    "written_orphans": (written_orphans, " UNION ALL ".join(f"SELECT '{f.name}' AS fk, count(*) FILTER ({f.columns[0]} NOT IN (SELECT {f.ref_columns[0]} FROM {f.parent})) AS n_orphans FROM {f.child}"
                                                            for f in STAR_FKS if f.child in ("nation", "customer", "orders"))),
    "stream_mask": (stream_mask, f"SELECT c_custkey, {MASK_SQL['email']} AS c_name, c_nationkey, c_acctbal, 'REDACTED' AS c_mktsegment FROM customer"),
    "stream_scan": (stream_scan, "SELECT table_name, column_name, kind, matches FROM (" + " UNION ALL ".join(_finding_sql("documents", "text", "doc_id", c) for c in CHECKS) + ") WHERE matches > 0"),
}
