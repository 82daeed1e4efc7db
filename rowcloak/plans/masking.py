"""Queries on masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.nested import mask_json, mask_json_schema, mask_nested
from ..functions.variants import mask_variant
from ..functions.rules import FIRST_NAMES, LAST_NAMES, STREETS, clamp, mask
from ..model import RelationalModel, TableSpec
from ..operators.masking import Classifier, mask_table, mask_unique, recompute_generated, rule_plan, unclassified
from ..operators.profile import profile, recommendations, sensitive_summary
from ..sources.tables import star_model

SEED = "demo-seed"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _masked(table: str, key: str, value, rule: str, **kw):
    def run(spark, d):
        df = _table(spark, d, table).withColumn("v", F.expr(value))
        return df.select(key, mask(F.col("v"), rule, df.schema["v"].dataType, SEED, **kw).alias("masked"))

    return run


def H(x: str, salt: int = 0) -> str:
    return f"sha256('{SEED}' || chr(0) || {x}" + (f" || repeat(chr(0), 7) || chr({salt})" if salt else "") + ")"


def N(x: str) -> str:
    return f"('0x' || substr({H(x)}, 1, 16))::UBIGINT"


def _words(words: list[str], i: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][({i})::INT + 1]"


def _off(x: str) -> str:
    return f"(({N(x)} % 61)::INT - 30)"


V = "c_name"
SQL = {
    "email": f"'user_' || substr({H(V)}, 1, 16) || '@example.invalid'",
    "phone": f"'+1555' || lpad(({N(V)} % 10000000)::VARCHAR, 7, '0')",
    "govid": f"upper(substr({H(V)}, 1, 11))",
    "first_name": _words(FIRST_NAMES, f"{N(V)} % 16"),
    "last_name": _words(LAST_NAMES, f"{N(V)} % 16"),
    "name": f"{_words(FIRST_NAMES, f'{N(V)} % 16')} || ' ' || {_words(LAST_NAMES, f'({N(V)} // 16) % 16')}",
    "address": f"({N(V)} % 900 + 100)::VARCHAR || ' ' || {_words(STREETS, f'{N(V)} % 6')} || ' St'",
    "ip": f"'203.0.113.' || ({N(V)} % 254 + 1)::VARCHAR",
    "secret": "'REDACTED'",
}
#: JSON text made of customers, and what masking makes of it.
JSON_TEXT = """concat('{"full_name":"', c_name, '","id":', c_custkey, ',"contact":{"email":"', c_name, '@corp.com"},"tags":["a"]}')"""
_MAIL = "c_name || '@corp.com'"
_JSON_SQL = f"""'{{"contact":{{"email":"user_' || substr({H(_MAIL)}, 1, 16) || '@example.invalid"}},"full_name":"' || {SQL['name']} || '","id":' || c_custkey || ',"tags":["a"]}}'"""


def clamped(spark, d):
    df = _table(spark, d, "customer")
    return df.select("c_custkey", mask(F.col("c_name"), "email", StringType(), SEED, max_len=20).alias("masked"), clamp(F.col("c_name"), 12).alias("clamped"))


def date_text(spark, d):
    df = _table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    texts = [F.concat(day, F.lit(tail)) for tail in _TAILS] + [F.concat(F.lit("on "), F.col("o_orderpriority")), F.concat(day, F.lit(" 99:99:99"))]
    text = F.element_at(F.array(*texts), (F.col("o_orderkey") % len(texts) + 1).cast("int"))
    return df.select("o_orderkey", mask(text, "date_shift", StringType(), SEED).alias("masked"))


#: What follows the day in each layout.
_TAILS = ["", " 01:02:03", " 01:02:03.25", " 01:02:03+02", " 01:02:03.5-07", "T01:02:03Z", "T01:02:03.125+05:30"]
_TEXT_SQL = "[" + ", ".join(f"strftime(o_orderdate, '%Y-%m-%d') || '{tail}'" for tail in _TAILS) + ", 'on ' || o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') || ' 99:99:99'][o_orderkey % 9 + 1]"


def unique(rules: dict[str, str], **types):
    def run(spark, d):
        df = _table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
        return mask_unique(df, list(rules), rules, ["c_custkey"], SEED, **types)

    return run


def json_query(spark, d):
    df = _table(spark, d, "customer")
    return df.select("c_custkey", mask_json(F.expr(JSON_TEXT), SEED).alias("masked"))


def json_variant_query(spark, d):
    df = _table(spark, d, "customer")
    return df.select("c_custkey", mask_variant(F.expr(JSON_TEXT), SEED).alias("masked"))


def json_schema_query(spark, d):
    schema = StructType([StructField("contact", StructType([StructField("email", StringType())])), StructField("full_name", StringType())])
    return _table(spark, d, "customer").select("c_custkey", mask_json_schema(F.expr(JSON_TEXT), schema, SEED).alias("masked"))


def nested_query(spark, d):
    df = _table(spark, d, "customer").withColumn("v", F.expr("struct(c_name as display_name, array(struct(c_name as email, c_custkey as id)) as contacts, map('phone', c_name, 'other', c_mktsegment) as more)"))
    out = df.select("c_custkey", mask_nested(F.col("v"), df.schema["v"].dataType, SEED).alias("v"))
    return out.select("c_custkey", "v.display_name", F.col("v.contacts")[0]["email"].alias("email"), F.col("v.contacts")[0]["id"].alias("id"), F.col("v.more")["phone"].alias("phone"), F.col("v.more")["other"].alias("other"))


def masked_join(spark, d):
    """Names masked apart in two tables still join."""
    c = _table(spark, d, "customer").select("c_custkey", "c_nationkey", mask(F.col("c_name"), "email", StringType(), SEED).alias("m"))
    o = _table(spark, d, "orders").join(_table(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", mask(F.col("c_name"), "email", StringType(), SEED).alias("m"))
    return c.join(o, "m").groupBy("c_nationkey").agg(F.count("*").alias("n_orders"))


def mask_customer(spark, d):
    return mask_table(star_model(spark, d), "customer", SEED, Classifier({"customer.c_name": "secret", "customer.c_mktsegment": "redact", "c_acctbal": "secret"}))


def generated(spark, d):
    df = _table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.concat_ws(":", "c_name", "c_mktsegment").alias("label"))
    t = TableSpec("customer", df, ("c_custkey",), generated={"label": "concat_ws(':', c_name, c_mktsegment)"})
    return mask_table(RelationalModel([t]), "customer", SEED, Classifier({"c_name": "email"}))


def recomputed(spark, d):
    df = _table(spark, d, "part").withColumn("label", F.lit("stale"))
    t = TableSpec("part", df, ("p_partkey",), generated={"label": "concat(p_brand, '/', p_size)"})
    return recompute_generated(df.drop("label"), t).select("p_partkey", "label")


def classified(spark, d):
    m = star_model(spark, d)
    plan = rule_plan(m, Classifier({"part.p_type": "keep", "events.props": "redact"}))
    return plan.join(profile(m).select("table_name", "column_name", "n_null"), ["table_name", "column_name"]).where("type = 'string'").select(
        "table_name", "column_name", "rule", "source", "action", "n_null")


def violations(spark, d):
    m = star_model(spark, d)
    left = spark.createDataFrame(unclassified(m, Classifier({"part.p_type": "keep"})), "table_name string, column_name string")
    return profile(m).join(left, ["table_name", "column_name"]).select("table_name", "column_name", "n_distinct")


def recommended(spark, d):
    m = star_model(spark, d)
    return recommendations(m, unclassified(m, Classifier()))


def by_table(spark, d):
    return sensitive_summary(star_model(spark, d), Classifier({"events.props": "redact"})).withColumns(
        {c: F.col(c).cast("long") for c in ("n_masked", "n_redacted", "n_unreviewed")})


#: String columns of the star schema, their default rule, and whether they are unreviewed.
_STRINGS = [("region", "r_name", "name"), ("nation", "n_name", "name"), ("customer", "c_name", "name"), ("customer", "c_mktsegment", "keep"), ("supplier", "s_name", "name"),
            ("part", "p_name", "name"), ("part", "p_brand", "keep"), ("part", "p_type", "keep"), ("orders", "o_orderstatus", "keep"), ("orders", "o_orderpriority", "keep"),
            ("lineitem", "l_returnflag", "keep"), ("lineitem", "l_linestatus", "keep"), ("events", "event_type", "keep"), ("events", "props", "keep")]


def _classified_sql(t: str, c: str, rule: str) -> str:
    source, action = ("name", "masked") if rule == "name" else ("default", "unreviewed")
    if (t, c) == ("part", "p_type"):
        source, action = "override", "kept"
    if (t, c) == ("events", "props"):
        rule, source, action = "redact", "override", "redacted"
    return f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{rule}' AS rule, '{source}' AS source, '{action}' AS action, count(*) FILTER ({c} IS NULL) AS n_null FROM {t}"


def _by_table_sql() -> str:
    out = []
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        masked = sum(r == "name" for n, _, r in _STRINGS if n == t)
        left = sum(r == "keep" and c != "props" for n, c, r in _STRINGS if n == t)
        out.append(f"SELECT '{t}' AS table_name, count(*) AS n_rows, {masked} AS n_masked, {int(t == 'events')} AS n_redacted, {left} AS n_unreviewed FROM {t}")
    return " UNION ALL ".join(out)


_RECOMMENDED = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, max(length({c})) AS max_length, CASE WHEN max(length({c})) <= 32 THEN 'keep' ELSE 'redact' END AS rule FROM {t}"
    for t, c, r in _STRINGS if r == "keep")


def _salted_sql(salts: int = 8) -> str:
    """The salts walked one by one: of equal values the lowest key stays, the others go on; values kept before are taken."""
    at = lambda s, x: f"('0x' || substr({H(x, s)}, 1, 16))::UBIGINT"
    both = lambda s: f"upper(substr({H('c_name', s)}, 1, 3)) AS a, {_words(LAST_NAMES, at(s, 'c_mktsegment') + ' % 16')} AS b"
    ctes = []
    for s in range(salts):
        rows = "customer" if s == 0 else f"(SELECT * FROM customer WHERE c_custkey NOT IN ({' UNION ALL '.join(f'SELECT c_custkey FROM w{i}' for i in range(s))}))"
        free = "" if s == 0 else f"WHERE (a, b) NOT IN ({' UNION ALL '.join(f'SELECT (a, b) FROM w{i}' for i in range(s))})"
        ctes.append(f"w{s} AS MATERIALIZED (SELECT min(c_custkey) AS c_custkey, a, b FROM (SELECT c_custkey, {both(s)} FROM {rows}) {free} GROUP BY a, b)")
    return f"WITH {', '.join(ctes)} SELECT c_custkey, a AS c_name, b AS c_mktsegment FROM ({' UNION ALL '.join(f'SELECT * FROM w{s}' for s in range(salts))})"


QUERIES = {f"mask_{rule}": (_masked("customer", "c_custkey", "c_name", rule), f"SELECT c_custkey, {sql} AS masked FROM customer") for rule, sql in SQL.items()} | {
    "mask_redact": (_masked("customer", "c_custkey", "c_mktsegment", "redact", nullable=False), "SELECT c_custkey, '' AS masked FROM customer"),
    "mask_int": (_masked("part", "p_partkey", "p_size", "phone"), f"SELECT p_partkey, ({N('p_size::VARCHAR')} % 1000000000)::INT AS masked FROM part"),
    "mask_long": (_masked("lineitem", "l_orderkey", "l_suppkey", "govid"), f"SELECT l_orderkey, ({N('l_suppkey::VARCHAR')} % 1000000000000)::BIGINT AS masked FROM lineitem"),
    "mask_float": (_masked("customer", "c_custkey", "c_acctbal", "secret"), f"SELECT c_custkey, ({N('c_acctbal::VARCHAR')} % 1000000000) / 100 AS masked FROM customer"),
    "mask_decimal": (lambda spark, d: _masked("customer", "c_custkey", "cast(c_acctbal as decimal(12,2))", "secret")(spark, d).withColumn("masked", F.col("masked").cast("string")),
                     f"SELECT c_custkey, (({N('c_acctbal::DECIMAL(12,2)::VARCHAR')} % 1000000000)::VARCHAR || '.' || lpad(({N('c_acctbal::DECIMAL(12,2)::VARCHAR')} % 100)::VARCHAR, 2, '0'))::DECIMAL(12,2)::VARCHAR AS masked FROM customer"),
    "mask_uuid": (_masked("customer", "c_custkey", "c_name", "secret", tag="uuid"),
                  f"WITH x AS (SELECT c_custkey, {H(V)} AS h FROM customer) SELECT c_custkey, substr(h,1,8) || '-' || substr(h,9,4) || '-4' || substr(h,14,3) || '-8' || substr(h,18,3) || '-' || substr(h,21,12) AS masked FROM x"),
    "mask_inet": (_masked("customer", "c_custkey", "c_name", "email", tag="inet"), f"SELECT c_custkey, {SQL['ip']} AS masked FROM customer"),
    "date_shift_date": (_masked("orders", "o_orderkey", "cast(o_orderdate as date)", "date"),
                        f"SELECT o_orderkey, (o_orderdate::DATE + {_off('''strftime(o_orderdate, '%Y-%m-%dT00:00:00Z')''')}) AS masked FROM orders"),
    "date_shift_timestamp": (_masked("orders", "o_orderkey", "o_orderdate", "date_shift"),
                             f"SELECT o_orderkey, o_orderdate + to_days({_off('''strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')''')}) AS masked FROM orders"),
    "date_shift_text": (date_text, f"""
        WITH x AS (SELECT o_orderkey, o_orderdate, {_TEXT_SQL} AS v FROM orders)
        SELECT o_orderkey, CASE WHEN v LIKE 'on %' OR v LIKE '% 99:99:99' THEN printf('%04d-%02d-%02d', (2020 + {N('v')} % 6)::INT, (1 + {N('v')} % 12)::INT, (1 + {N('v')} % 28)::INT)
          ELSE strftime(substr(v, 1, 10)::DATE + {_off('v')}, '%Y-%m-%d') || substr(v, 11) END AS masked FROM x"""),
    "clamp": (clamped, f"SELECT c_custkey, substr({SQL['email']}, 1, 20) AS masked, substr(c_name, 1, 12) AS clamped FROM customer"),
    "unique_secret": (unique({"c_name": "secret"}), f"SELECT c_custkey, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer) THEN 'REDACTED' ELSE 'REDACTED-' || substr({H(V, 1)}, 1, 12) END AS c_name, c_mktsegment FROM customer"),
    "unique_email": (unique({"c_name": "email"}), f"SELECT c_custkey, {SQL['email']} AS c_name, c_mktsegment FROM customer"),
    "unique_composite": (unique({"c_name": "email", "c_mktsegment": "secret"}), f"SELECT c_custkey, {SQL['email']} AS c_name, 'REDACTED' AS c_mktsegment FROM customer"),
    "unique_salted": (unique({"c_name": "govid", "c_mktsegment": "last_name"}, c_name={"max_len": 3}), _salted_sql()),
    "mask_json": (json_query, f"SELECT c_custkey, {_JSON_SQL} AS masked FROM customer"),
    "mask_json_variant": (json_variant_query, f"SELECT c_custkey, {_JSON_SQL} AS masked FROM customer"),
    "mask_json_schema": (json_schema_query, f"""SELECT c_custkey, '{{"contact":{{"email":"user_' || substr({H(_MAIL)}, 1, 16) || '@example.invalid"}},"full_name":"' || {SQL['name']} || '"}}' AS masked FROM customer"""),
    "mask_nested": (nested_query, f"SELECT c_custkey, {SQL['name']} AS display_name, {SQL['email']} AS email, c_custkey AS id, {SQL['phone']} AS phone, c_mktsegment AS other FROM customer"),
    "masked_join": (masked_join, "SELECT c_nationkey, count(*) AS n_orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "mask_customer": (mask_customer, f"""SELECT c_custkey, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer) THEN 'REDACTED' ELSE 'REDACTED-' || substr({H(V, 1)}, 1, 12) END AS c_name,
        c_nationkey, ({N('c_acctbal::VARCHAR')} % 1000000000) / 100 AS c_acctbal, NULL::VARCHAR AS c_mktsegment FROM customer"""),
    "generated_recompute": (generated, f"SELECT c_custkey, {SQL['email']} AS c_name, c_mktsegment, {SQL['email']} || ':' || c_mktsegment AS label FROM customer"),
    "generated_columns": (recomputed, "SELECT p_partkey, p_brand || '/' || p_size AS label FROM part"),
    "classify_columns": (classified, " UNION ALL ".join(_classified_sql(*x) for x in _STRINGS)),
    "strict_violations": (violations, " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM {t}" for t, c, r in _STRINGS if r == "keep" and c != "p_type")),
    "recommend_rules": (recommended, _RECOMMENDED),
    "masking_by_table": (by_table, _by_table_sql()),
}
