"""The native walk over JSON against the one row by row."""

import json

from pyspark.sql import functions as F

from rowcloak.functions.nested import mask_json
from rowcloak.functions.variants import mask_variant

DOCS = [{"customer": {"email": "a@b.c", "name": "Ann", "note": "say \"hi\"\né"}, "tags": ["x", 1, None, True], "count": 2, "phone": 5, "nothing": None, "list": [{"ip": "8.8.8.8", "z": 1.5}]},
        {"b": 1, "a": {"dob": "1990-05-15", "token": "t", "ok": False}, "ssn": "123", "empty": {}, "none": []}, [], {}, "email", 12, None, [{"email": "x@y.z"}, [{"name": "Bo"}]]]


def test_like_the_walk_by_rows(spark):
    texts = [json.dumps(d) for d in DOCS] + ["not json", None, "", "{", '{"a":NaN}']
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for strict in (False, True):
        out = df.select("v", mask_variant(F.col("v"), "s", strict=strict).alias("a"), mask_json(F.col("v"), "s", strict).alias("b"))
        assert [(r.v, r.a) for r in out.collect()] == [(r.v, r.b) for r in out.collect()]
    native = df.select(mask_variant(F.col("v"), "s"))
    assert "Python" not in native._jdf.queryExecution().executedPlan().toString()


def test_nothing_unseen_is_let_out(spark):
    df = spark.createDataFrame([('{"a":{"b":{"c":{"email":"real@mail.org"},"n":1}}}',), ('{"a":1,"a":2}',)], "v string")
    deep, twice = (r[0] for r in df.select(mask_variant(F.col("v"), "s", depth=3)).collect())
    assert json.loads(deep) == {"a": {"b": {"c": "REDACTED", "n": 1}}} and twice == "{}"
    assert "user_" in df.select(mask_variant(F.col("v"), "s", depth=4)).first()[0]
