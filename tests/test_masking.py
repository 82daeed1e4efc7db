import datetime as dt
import hashlib
import json

import pytest
from fixtures import kitchen_sink
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rowcloak.functions.digest import digest, number
from rowcloak.functions.nested import mask_json
from rowcloak.functions.rules import FIRST_NAMES, UnsupportedType, mask, parse_rule, rule_for_name
from rowcloak.model import ModelError, RelationalModel, TableSpec
from rowcloak.operators.masking import Classifier, domain, mask_table, mask_unique, maskable_schema, recommend, unclassified


def h(value, seed="s", salt=0):
    return hashlib.sha256(seed.encode() + b"\0" + value.encode() + (salt.to_bytes(8, "big") if salt else b"")).hexdigest()


def one(spark, value, rule, kind="string", **kw):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(mask(F.col("v"), rule, df.schema["v"].dataType, "s", **kw)).first()[0]


def test_digest(spark):
    df = spark.createDataFrame([("jörg", 0), ("x", 300)], "v string, k int")
    got = df.select(digest(F.col("v"), "s", F.col("k")), digest(F.col("v"), "s", 300)).collect()
    assert got[0][0] == h("jörg") and got[1][0] == h("x", salt=300) == got[1][1]
    assert int(df.select(number(digest(F.col("v"), "s"))).first()[0]) == int(h("jörg")[:16], 16)


def test_text_rules(spark):
    v = "john@corp.com"
    d = h(v)
    n = int(d[:16], 16)
    assert one(spark, v, "email") == f"user_{d[:16]}@example.invalid"
    assert one(spark, v, "phone") == f"+1555{n % 10**7:07d}"
    assert one(spark, v, "govid") == d[:11].upper()
    assert one(spark, v, "first_name") == FIRST_NAMES[n % 16]
    assert one(spark, v, "ip") == f"203.0.113.{n % 254 + 1}"
    assert one(spark, v, "secret") == "REDACTED" and one(spark, v, "secret", salt=2) == f"REDACTED-{h(v, salt=2)[:12]}"
    assert one(spark, v, "email", max_len=9) == f"user_{d[:4]}"
    assert one(spark, None, "email") is None and one(spark, v, "redact") is None and one(spark, v, "redact", nullable=False) == ""
    assert one(spark, v, "keep") == v


def test_types(spark):
    from decimal import Decimal

    n = int(h("7")[:16], 16)
    assert one(spark, 7, "phone", "bigint") == n % 10**12 and one(spark, 7, "phone", "int") == n % 10**9 and one(spark, 7, "phone", "tinyint") == n % 100
    m = int(h("1.50")[:16], 16)
    assert one(spark, Decimal("1.50"), "secret", "decimal(5,2)") == Decimal(f"{m % 1000}.{m % 100:02d}")
    d = one(spark, "x", "govid", tag="uuid")
    assert len(d) == 36 and d[14] == "4" and d[19] == "8"
    assert one(spark, "10.1.1.1", "email", tag="inet").startswith("203.0.113.")
    assert one(spark, 3, "redact", "int", nullable=False) == 0
    for kind, value in (("array<string>", ["x"]), ("boolean", True), ("binary", b"x")):
        with pytest.raises(UnsupportedType):
            one(spark, value, "email", kind)
        assert one(spark, value, "keep", kind) == value
    with pytest.raises(UnsupportedType):
        maskable_schema(spark.range(1).select(F.array("id").alias("a")).schema, {"a": "email"})


def test_dates(spark):
    n = int(h("1990-05-15T00:00:00Z")[:16], 16)
    assert one(spark, dt.date(1990, 5, 15), "date", "date") == dt.date(1990, 5, 15) + dt.timedelta(days=n % 61 - 30)
    for text, tail in (("1990-05-15", ""), ("1990-05-15 10:11:12", " 10:11:12"), ("1990-05-15T10:11:12.5Z", "T10:11:12.5Z"), ("1990-05-15 10:11:12+02", " 10:11:12+02")):
        off = int(h(text)[:16], 16) % 61 - 30
        assert one(spark, text, "date_shift") == (dt.date(1990, 5, 15) + dt.timedelta(days=off)).isoformat() + tail
    k = int(h("soon")[:16], 16)
    assert one(spark, "soon", "date_shift") == f"{2020 + k % 6:04d}-{1 + k % 12:02d}-{1 + k % 28:02d}"
    assert one(spark, "2020-13-45", "date_shift")[:2] == "20"


def test_dates_in_columns_and_in_json_agree(spark):
    texts = ["1990-05-15", "1990-05-15 10:11:12", "1990-05-15 10:11:12.25", "1990-05-15T10:11:12Z", "1990-05-15T10:11:12.5+02:00", "1990-05-15 10:11:12+02", "9999-12-31", "9999-12-31 23:59:59",
             "0001-01-01", "0000-05-05", "2020-01-01 99:99:99", "2020-01-01 24:00:00", "2020-02-30", "2020-02-29 23:59:60", "soon", "", "2020-01-01 10:11", " 2020-01-01"]
    df = spark.createDataFrame([(t, json.dumps({"dob": t})) for t in texts * 3], "v string, j string")
    got = df.select("v", mask(F.col("v"), "date_shift", StringType(), "s").alias("a"), F.get_json_object(mask_json(F.col("j"), "s"), "$.dob").alias("b")).collect()
    assert [(r.v, r.a) for r in got] == [(r.v, r.b) for r in got]
    assert all(len(r.a) in (10, 19, 20, 22, 27) and r.a[4] == "-" for r in got)


@pytest.mark.parametrize("name,rule", [
    ("password_hash", "secret"), ("api_key", "secret"), ("email", "email"), ("billing_email", "email"), ("user_mail", "email"), ("phone", "phone"), ("ssn", "govid"), ("iban", "govid"),
    ("license_no", "govid"), ("first_name", "first_name"), ("surname", "last_name"), ("full_name", "name"), ("c_name", "name"), ("ip_address", "ip"), ("last_login_ip", "ip"),
    ("address_line_2", "address"), ("zipcode", "address"), ("DOB", "date_shift"), ("description", "keep"), ("shipping", "keep"), ("filename", "keep")])
def test_names(name, rule):
    assert rule_for_name(name) == ("keep" if name == "password_hash_x" else rule)


def test_overrides_and_review(spark):
    c = Classifier({"name": "keep", "companies.name": "secret", "public.companies.name": "email"})
    assert [c.rule(t, "name") for t in ("public.companies", "x.companies", "users")] == ["email", "secret", "keep"]
    with pytest.raises(ValueError):
        Classifier({"x": "scramble"})
    with pytest.raises(ValueError):
        parse_rule("nope")
    m = kitchen_sink(spark)
    assert unclassified(m, Classifier({"sku": "keep"})) == [("comments", "commentable_type"), ("comments", "body"), ("companies", "slug")]
    assert unclassified(m, Classifier(), ["order_items"]) == [("order_items", "sku")]
    assert [recommend("slug", True, 9), recommend("bio", False, 9), recommend("status", False, 16), recommend("x", False, 99)] == ["secret", "redact", "keep", "redact"]


def test_unique_repair(spark):
    df = spark.createDataFrame([(i, f"key{i}") for i in range(40)] + [(99, None), (100, None)], "id long, api_key string")
    rows = mask_unique(df, ["api_key"], {"api_key": "secret"}, ["id"], "s").orderBy("id").collect()
    assert rows[0].api_key == "REDACTED" and len({r.api_key for r in rows}) == 41 and rows[-1].api_key is None
    names = mask_unique(df.where("id < 16"), ["api_key"], {"api_key": "first_name"}, ["id"], "s").collect()
    assert len({r.api_key for r in names}) == 16
    with pytest.raises(ModelError):
        mask_unique(df, ["api_key"], {"api_key": "first_name"}, ["id"], "s")
    small = spark.range(101).selectExpr("id", "cast(id as tinyint) as n", "concat('k', id) as t")
    for column, kw in (("n", {}), ("t", {"t": {"max_len": 6}}), ("t", {"t": {"max_len": 9}})):  # 100, 16 and 2 values, or 1
        rule = {"n": "phone", "t": "email" if kw.get("t", {}).get("max_len") == 6 else "secret"}
        with pytest.raises(ModelError, match="more values"):
            mask_unique(small, [column], rule, ["id"], "s", **kw)
    assert domain("secret", StringType(), 12) == 16**3 + 1 and domain("email", StringType(), 200) == 16**16 and domain("name", StringType(), 30) == 256
    two = spark.createDataFrame([(i, f"a{i % 3}", f"b{i}") for i in range(30)], "id long, a string, b string")
    pairs = mask_unique(two, ["a", "b"], {"a": "first_name", "b": "last_name"}, ["id"], "s").collect()
    assert len({(r.a, r.b) for r in pairs}) == 30
    t = TableSpec("t", df.where("api_key is not null"), ("id",), (("api_key",),), frozenset({"api_key"}))
    with pytest.raises(ModelError):
        mask_table(RelationalModel([t]), "t", "s", Classifier({"api_key": "redact"}))


def test_partitioning_does_not_matter(spark):
    m = kitchen_sink(spark)
    a = mask_table(m, "users", "s").orderBy("id").collect()
    assert a == mask_table(m, "users", "s", df=m.table("users").df.repartition(7)).orderBy("id").collect()
    assert a != mask_table(m, "users", "t").orderBy("id").collect()


def test_json(spark):
    doc = {"customer": {"email": "a@b.c", "name": "Ann"}, "tags": ["x"], "count": 2, "phone": 5, "nothing": None, "list": [{"ip": "8.8.8.8"}]}
    df = spark.createDataFrame([(json.dumps(doc),), ("not json",), (None,), ("[1, 2]",), ("9007199254740993",)], "v string")
    got = [r[0] for r in df.select(mask_json(F.col("v"), "s")).collect()]
    x = json.loads(got[0])
    assert x["customer"]["email"] == f"user_{h('a@b.c')[:16]}@example.invalid" and x["phone"] == 5 and x["tags"] == ["x"] and x["list"][0]["ip"].startswith("203.")
    assert got[1:] == ["{}", None, "[1,2]", "9007199254740993"]
    odd = spark.createDataFrame([('{"a":NaN}',), ('{"a":1e999}',), ('{"a":"\\ud800"}',), ('{"email":"\\ud800"}',), ("[" * 100_000,)], "v string")
    assert {r[0] for r in odd.select(mask_json(F.col("v"), "s")).collect()} == {"{}"}
    variant = spark.createDataFrame([('{"email":"a@b.c","n":[1,null]}',), (None,)], "v string").select(F.parse_json("v").alias("v"))
    out = [r[0] for r in variant.select(F.to_json(mask(F.col("v"), "name", variant.schema["v"].dataType, "s"))).collect()]
    assert json.loads(out[0]) == {"email": x["customer"]["email"], "n": [1, None]} and out[1] is None
    strict = json.loads(df.select(mask_json(F.col("v"), "s", strict=True)).first()[0])
    assert strict["phone"].startswith("+1555") and strict["count"] == 2
    assert mask(F.col("v"), "secret", StringType(), "s", tag="json") is not None and one(spark, "{}", "secret", tag="json") == "{}"
