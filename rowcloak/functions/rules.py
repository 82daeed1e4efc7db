"""Masking rules: deterministic substitutes by rule and type."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, TimestampNTZType, TimestampType, VariantType,
)

from .digest import canonical, digest, modulo, number

# Rules, word lists, and the patterns of column names in order.
RULES = ("keep", "redact", "secret", "email", "phone", "govid", "first_name", "last_name", "name", "address", "ip", "date_shift", "date")
FIRST_NAMES = "Alex Sam Jordan Riley Casey Morgan Avery Quinn Rowan Skyler Emery Finley Harper Kai Noor Zaid".split()
LAST_NAMES = "Rivera Chen Okafor Novak Haddad Silva Kowalski Nguyen Ferrari Andersen Costa Mbeki Yilmaz Park Reyes Dubois".split()
STREETS = "Example Placeholder Sample Fixture Sandbox Reference".split()
NAME_RULES = [
    ("secret", "password|passwd|pwd|secret|token|api_?key|private_?key|access_?key"),
    ("email", "e?mail"),
    ("phone", "phone|mobile|tel|telephone|msisdn|fax"),
    ("govid", "ssn|sin|nino|national_?id|tax_?id|passport|licen[cs]e_?no"),
    ("govid", "iban|bic|swift|card_?number|cc_?num|pan|cvv|account_?number"),
    ("first_name", "first_?name|given_?name|forename"),
    ("last_name", "last_?name|surname|family_?name"),
    ("name", "full_?name|display_?name|name"),
    ("ip", "ip(_?addr(ess)?)?"),
    ("address", r"address|street|address_?line_?\d*|post_?code|zip_?code|postal_?code"),
    ("date_shift", "dob|birth_?date|date_of_birth|birthday"),
]
#: Date layouts tried in order on text: the shape, Spark's format, and how many fraction digits to keep.
LAYOUTS = [
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$", "yyyy-MM-dd'T'HH:mm:ss", "zone"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?[+-]\d{2}$", "yyyy-MM-dd HH:mm:ss", "zone"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$", "yyyy-MM-dd HH:mm:ss", ""),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd", ""),
]


class UnsupportedType(TypeError):
    """A masking rule on a type that has no substitutes: an error, never a guess."""


def parse_rule(rule: str) -> str:
    if rule not in RULES:
        raise ValueError(f"unknown mask rule {rule!r}")
    return rule


def rule_for_name(column: str) -> str:
    """The default rule of a column or JSON key by its name: the first pattern that fits, else keep."""
    for rule, tokens in NAME_RULES:
        if re.search(f"(^|_)({tokens})($|_)", column.lower()):
            return rule
    return "keep"


def kind_of(kind: DataType, tag: str | None = None) -> str:
    if tag in ("uuid", "inet", "json"):
        return tag
    for name, types in (("text", StringType), ("int", (ByteType, ShortType, IntegerType, LongType)), ("float", (FloatType, DoubleType)),
                        ("decimal", DecimalType), ("date", DateType), ("time", (TimestampType, TimestampNTZType)), ("json", VariantType)):
        if isinstance(kind, types):
            return name
    return "other"


def _pick(words: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (i + 1).cast("int"))


def _offset(n: Column, salt: int | Column) -> Column:
    return (modulo(n, 61) - 30 + salt).cast("int")


def shift_text(value: Column, n: Column, salt: int | Column = 0) -> Column:
    """A date in text, shifted and written in the layout it has.

    Other text gets a date from the digest, so does a date that is none, or that leaves the years 1 to 9999.
    """
    out = F.format_string("%04d-%02d-%02d", 2020 + modulo(n, 6), 1 + modulo(n, 12), 1 + modulo(n, 28))
    for shape, layout, _ in reversed(LAYOUTS):
        size = len(layout.replace("'", ""))
        head, tail = F.substring(value, 1, size), F.substr(value, F.lit(size + 1))  # fraction and zone stay
        then = F.try_to_timestamp(head, F.lit(layout)).cast("timestamp_ntz")
        day = F.date_add(then.cast("date"), _offset(n, salt))
        fits = then.isNotNull() & (F.year(then) >= 1) & F.year(day).between(1, 9999)
        shifted = F.concat(F.date_format(day, "yyyy-MM-dd"), F.substr(head, F.lit(11)), tail)
        out = F.when(value.rlike(shape) & fits, shifted).otherwise(out)
    return out


def text_value(rule: str, h: Column, n: Column, value: Column, salt: int | Column) -> Column:
    if rule == "email":
        return F.concat(F.lit("user_"), F.substring(h, 1, 16), F.lit("@example.invalid"))
    if rule == "phone":
        return F.concat(F.lit("+1555"), F.lpad(modulo(n, 10**7).cast("string"), 7, "0"))
    if rule == "govid":
        return F.upper(F.substring(h, 1, 11))
    if rule == "first_name":
        return _pick(FIRST_NAMES, modulo(n, 16))
    if rule == "last_name":
        return _pick(LAST_NAMES, modulo(n, 16))
    if rule == "name":
        sixteenth = F.floor(n / F.lit(16).cast("decimal(20,0)")).cast("decimal(20,0)")
        return F.concat_ws(" ", _pick(FIRST_NAMES, modulo(n, 16)), _pick(LAST_NAMES, modulo(sixteenth, 16)))
    if rule == "address":
        return F.concat((modulo(n, 900) + 100).cast("string"), F.lit(" "), _pick(STREETS, modulo(n, 6)), F.lit(" St"))
    if rule == "ip":
        return F.concat(F.lit("203.0.113."), (modulo(n, 254) + 1).cast("string"))
    if rule == "secret":
        again = F.concat(F.lit("REDACTED-"), F.substring(h, 1, 12))
        return (again if salt else F.lit("REDACTED")) if isinstance(salt, int) else F.when(salt > 0, again).otherwise(F.lit("REDACTED"))
    if rule in ("date", "date_shift"):
        return shift_text(value, n, salt)
    raise ValueError(f"unknown mask rule {rule!r}")


def redacted(kind: DataType, what: str, nullable: bool) -> Column:
    """Null, or the type's empty value where the column has to have one."""
    if nullable:
        return F.lit(None).cast(kind)
    if what in ("int", "float", "decimal"):
        return F.lit(0).cast(kind)
    if what == "date":
        return F.to_date(F.lit("0001-01-01"))
    if what == "time":
        return F.lit("0001-01-01 00:00:00").cast(kind)
    if what == "json":
        return F.lit("{}") if isinstance(kind, StringType) else F.parse_json(F.lit("{}"))
    if what == "text":
        return F.lit("")
    raise UnsupportedType(f"a not-null {what} can't be redacted")


#: Bounds of masked whole numbers, so that they fit their column.
INT_BOUNDS = {ByteType: 10**2, ShortType: 10**4, IntegerType: 10**9, LongType: 10**12}


def clamp(value: Column, max_len: int | None) -> Column:
    return F.substring(value, 1, max_len) if max_len and max_len > 0 else value


def mask(value: Column, rule: str, kind: DataType, seed: str, *, tag: str | None = None, max_len: int | None = None,
         nullable: bool = True, salt: int | Column = 0) -> Column:
    """The substitute for a value; null stays null."""
    parse_rule(rule)
    if rule == "keep":
        return value
    what = kind_of(kind, tag)
    if rule == "redact":
        return F.when(value.isNotNull() | F.lit(not nullable), redacted(kind, what, nullable))
    if what == "other":
        raise UnsupportedType(f"rule {rule} can't mask {kind.simpleString()}")
    if what == "json":
        from .nested import mask_json

        if rule == "secret":
            return F.when(value.isNotNull(), redacted(kind, "json", False))
        return mask_json(value, seed) if isinstance(kind, StringType) else F.parse_json(mask_json(F.to_json(value), seed))
    h = digest(canonical(value, kind), seed, salt)
    n = number(h)
    if what == "int":
        out = modulo(n, next(b for t, b in INT_BOUNDS.items() if isinstance(kind, t))).cast(kind)
    elif what == "float":
        out = (modulo(n, 10**9) / 100).cast(kind)
    elif what == "decimal":
        whole, cents = modulo(n, 10 ** min(9, max(0, kind.precision - kind.scale))), modulo(n, 100)
        out = F.concat(whole.cast("string"), F.lit("."), F.lpad(cents.cast("string"), 2, "0")).cast("decimal(38,2)").cast(kind)
    elif what == "uuid":
        part = lambda a, k: F.substring(h, a + 1, k)
        out = F.concat_ws("-", part(0, 8), part(8, 4), F.concat(F.lit("4"), part(13, 3)), F.concat(F.lit("8"), part(17, 3)), part(20, 12))
    elif what == "inet":
        out = text_value("ip", h, n, value, salt)
    elif what == "date":
        out = F.date_add(value, _offset(n, salt))
    elif what == "time":
        out = (value + F.make_dt_interval(_offset(n, salt))).cast(kind)
    else:
        out = clamp(text_value(rule, h, n, value, salt), max_len)
    return F.when(value.isNotNull(), out)
