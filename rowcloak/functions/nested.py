"""Masking inside nested values: string leaves under keys whose names match a default rule."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from .rules import mask, rule_for_name


def mask_nested(value: Column, kind: DataType, seed: str, key: str = "") -> Column:
    """The same walk over native structs, arrays and maps, as one expression."""
    if isinstance(kind, StructType):
        fields = [mask_nested(value[f.name], f.dataType, seed, f.name).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: mask_nested(x, kind.elementType, seed)) if isinstance(kind.elementType, (StructType, ArrayType, MapType)) else value
    if isinstance(kind, MapType):
        if not isinstance(kind.keyType, StringType):
            return value
        if isinstance(kind.valueType, StringType):
            def by_name(k: Column, v: Column) -> Column:
                from .rules import NAME_RULES

                out = v
                for rule, tokens in reversed(NAME_RULES):
                    out = F.when(F.lower(k).rlike(f"(^|_)({tokens})($|_)"), mask(v, rule, StringType(), seed)).otherwise(out)
                return out

            return F.transform_values(value, by_name)
        return F.transform_values(value, lambda k, v: mask_nested(v, kind.valueType, seed))
    rule = rule_for_name(key) if key else "keep"
    return mask(value, rule, kind, seed) if isinstance(kind, StringType) and rule != "keep" else value


def mask_json_schema(value: Column, schema: StructType, seed: str) -> Column:
    """JSON text of a known schema: parsed, masked and written natively. Unparsable text gives ``{}``."""
    parsed = F.from_json(value, schema)
    return F.when(value.isNotNull(), F.coalesce(F.to_json(mask_nested(parsed, schema, seed)), F.lit("{}")))


def _leaf(rule: str, seed: str, value: str) -> str:
    """One string leaf, for documents whose shape is only known row by row."""
    import hashlib

    from .rules import FIRST_NAMES, LAST_NAMES, STREETS

    h = hashlib.sha256(seed.encode() + b"\0" + value.encode()).hexdigest()
    n = int(h[:16], 16)
    return {
        "secret": "REDACTED", "email": f"user_{h[:16]}@example.invalid", "phone": f"+1555{n % 10**7:07d}", "govid": h[:11].upper(),
        "first_name": FIRST_NAMES[n % 16], "last_name": LAST_NAMES[n % 16], "name": f"{FIRST_NAMES[n % 16]} {LAST_NAMES[n // 16 % 16]}",
        "ip": f"203.0.113.{n % 254 + 1}", "address": f"{n % 900 + 100} {STREETS[n % 6]} St",
    }.get(rule) or _shifted(value, n)


def _shifted(value: str, n: int) -> str:
    import datetime as dt
    import re

    from .rules import LAYOUTS

    if any(re.match(shape, value) for shape, _, _ in LAYOUTS):
        try:
            if value[11:13] == "24":
                raise ValueError("no such hour")
            then = dt.datetime.fromisoformat(value[:19].rstrip("\n"))
            return (then.date() + dt.timedelta(days=n % 61 - 30)).isoformat() + value[10:]
        except (ValueError, OverflowError):
            pass
    return f"{2020 + n % 6:04d}-{1 + n % 12:02d}-{1 + n % 28:02d}"


def _walk(x, seed: str, key: str, strict: bool):
    if isinstance(x, dict):
        return {k: _walk(v, seed, k, strict) for k, v in x.items()}
    if isinstance(x, list):
        return [_walk(v, seed, "", strict) for v in x]
    rule = rule_for_name(key) if key else "keep"
    if rule in ("keep", "redact") or x is None:
        return x
    if isinstance(x, str):
        return _leaf(rule, seed, x)
    return _leaf(rule, seed, json.dumps(x)) if strict else x


def mask_json(value: Column, seed: str, strict: bool = False) -> Column:
    """JSON text of any shape: keys sorted, compact; text that isn't JSON, or can't be written as such, gives ``{}``.

    ``strict`` masks numbers and booleans under a matching key too. Rows go through Arrow in
    batches; where the shape is known, mask_json_schema stays native.
    """
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(s):
            if s is None:
                return None
            try:
                out = json.dumps(_walk(json.loads(s), seed, "", strict), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
                out.encode()  # half a surrogate pair can't be
                return out
            except (ValueError, RecursionError):
                return "{}"

        for s in batches:
            yield pd.Series([one(x) for x in s], dtype=object)

    return run(value)
