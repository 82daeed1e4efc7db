"""Masking JSON of unknown shape natively: a walk over variants as one expression, to a stated depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .rules import NAME_RULES, mask

DEPTH = 3  # levels of containers that are walked, the outermost one included


def _quoted(text: Column) -> Column:
    """A string as JSON writes it."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _by_name(key: Column, text: Column, plain: Column, seed: str) -> Column:
    """``text`` masked by the first rule that the key's name fits, as JSON; ``plain`` where none does."""
    out = plain
    for rule, tokens in reversed(NAME_RULES):
        out = F.when(F.lower(key).rlike(f"(^|_)({tokens})($|_)"), _quoted(mask(text, rule, StringType(), seed))).otherwise(out)
    return out


def _joined(parts: Column, before: str, behind: str) -> Column:
    return F.concat(F.lit(before), F.array_join(parts, ","), F.lit(behind))


def _walk(value: Column, key: Column | None, seed: str, depth: int, strict: bool) -> Column:
    kind = F.schema_of_variant(value)
    is_object, is_array = kind.startswith("OBJECT"), kind.startswith("ARRAY")
    plain = F.to_json(value)
    leaf = plain
    if key is not None:
        leaf = F.when(kind == "STRING", _by_name(key, value.cast("string"), plain, seed))
        leaf = leaf.when(kind == "VOID", plain).otherwise(_by_name(key, plain, plain, seed)) if strict else leaf.otherwise(plain)
    if not depth:  # nothing deeper is looked at, so nothing of it is let out
        return F.when(is_object | is_array, F.lit('"REDACTED"')).otherwise(leaf)
    fields = F.transform(F.map_entries(value.cast("map<string,variant>")), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), _walk(e["value"], e["key"], seed, depth - 1, strict)))
    items = F.transform(value.cast("array<variant>"), lambda x: _walk(x, None, seed, depth - 1, strict))
    return F.when(is_object, _joined(fields, "{", "}")).when(is_array, _joined(items, "[", "]")).otherwise(leaf)


def mask_variant(value: Column, seed: str, depth: int = DEPTH, strict: bool = False) -> Column:
    """JSON text with string leaves masked by their keys' names: keys sorted, compact, without Python.

    Containers below ``depth`` levels, of which the outermost is the first, come out as "REDACTED",
    since nobody has looked at what is in them; ``mask_json`` walks to any depth, row by row. ``strict`` masks
    numbers and booleans under a matching key too. Text that isn't JSON, or repeats a key, gives
    ``{}``; null stays null. Numbers come out as variants hold them: 1.10 as 1.1.
    """
    parsed = F.try_parse_json(value)
    return F.when(value.isNotNull(), F.coalesce(F.when(parsed.isNotNull(), _walk(parsed, None, seed, depth, strict)), F.lit("{}")))
