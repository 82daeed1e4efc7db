"""Masking of tables: classification, one-projection masking, repair of unique columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.rules import FIRST_NAMES, INT_BOUNDS, LAST_NAMES, STREETS, UnsupportedType, kind_of, mask, parse_rule, rule_for_name
from ..model import ModelError, RelationalModel, TableSpec
from ..scratch import counted, materialise

SALTS = 4  # salts of the first block
MAX_SALT = 999
#: How many values a rule can give, whatever the salt; for the others a salt always finds more.
DOMAINS = {"first_name": len(FIRST_NAMES), "last_name": len(LAST_NAMES), "name": len(FIRST_NAMES) * len(LAST_NAMES), "ip": 254,
           "address": lcm(900, len(STREETS)), "phone": 10**7}
# Parts of names that speak of free text.
FREE_TEXT = ("body", "text", "note", "comment", "description", "content", "message", "summary", "bio", "about", "reason", "feedback", "answer")


@dataclass
class Classifier:
    """Rules by column: overrides by `schema.table.column`, `table.column` or `column`, then by name."""

    overrides: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for rule in self.overrides.values():
            parse_rule(rule)

    def _keys(self, table: str, column: str) -> list[str]:
        return [f"{table}.{column}", f"{table.rpartition('.')[2]}.{column}", column]

    def explicit(self, table: str, column: str) -> bool:
        return any(k in self.overrides for k in self._keys(table, column))

    def rule(self, table: str, column: str) -> str:
        return next((self.overrides[k] for k in self._keys(table, column) if k in self.overrides), None) or rule_for_name(column)


def rule_plan(model: RelationalModel, classifier: Classifier) -> DataFrame:
    """(table_name, column_name, type, rule, source, is_key, action): what masking does to each column."""
    rows = []
    for t in model.tables.values():
        keys = model.key_columns(t.name)
        for f in t.df.schema:
            rule = classifier.rule(t.name, f.name)
            source = "override" if classifier.explicit(t.name, f.name) else "name" if rule != "keep" else "default"
            is_key = f.name in keys
            if is_key:
                action = "key"
            elif f.name in t.generated:
                action = "generated"
            elif rule == "redact":
                action = "redacted"
            elif rule != "keep":
                action = "masked"
            else:
                text = kind_of(f.dataType, t.kinds.get(f.name)) == "text"
                action = "unreviewed" if text and source == "default" else "kept"
            rows.append((t.name, f.name, f.dataType.simpleString(), rule, source, is_key, action))
    spark = next(iter(model.tables.values())).df.sparkSession
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, rule string, source string, is_key boolean, action string")


def unclassified(model: RelationalModel, classifier: Classifier, pii_tables: list[str] | None = None) -> list[tuple[str, str]]:
    """Text columns that nobody has ruled on: no key, not generated, kept without an override."""
    out = []
    for t in model.tables.values():
        if pii_tables is not None and t.name not in pii_tables:
            continue
        keys = model.key_columns(t.name)
        for f in t.df.schema:
            if f.name in keys or f.name in t.generated or classifier.explicit(t.name, f.name):
                continue
            if kind_of(f.dataType, t.kinds.get(f.name)) in ("text",) and classifier.rule(t.name, f.name) == "keep":
                out.append((t.name, f.name))
    return out


def require_reviewed(model: RelationalModel, classifier: Classifier, pii_tables: list[str] | None = None) -> None:
    left = unclassified(model, classifier, pii_tables)
    if left:
        raise ModelError("unreviewed text columns: " + ", ".join(f"{t}.{c}" for t, c in left))


def recommend(name: str, unique_not_null: bool, max_length: int | None) -> str:
    """A rule for an undecided text column."""
    if unique_not_null:
        return "secret"
    if any(h in name.lower() for h in FREE_TEXT):
        return "redact"
    return "keep" if max_length and max_length <= 32 else "redact"


def _nullable(t: TableSpec, column: str) -> bool:
    return column not in t.not_null_columns()


def check_unique_rule(t: TableSpec, columns: tuple[str, ...], rule_of: dict[str, str]) -> None:
    """Refuse what can't stay unique, before any row is read."""
    rules = [rule_of[c] for c in columns]
    if len(columns) == 1 and rules == ["redact"] and not _nullable(t, columns[0]):
        raise ModelError(f"{t.name}.{columns[0]} is unique and not null, so it can't be redacted")


def domain(rule: str, kind, max_len: int | None = None) -> int:
    """How many values a rule can give a column, whatever the salt (10^30: no bound that matters)."""
    what = kind_of(kind)
    if what == "int":
        return next(b for t, b in INT_BOUNDS.items() if isinstance(kind, t))
    if what == "float":
        return 10**9
    if what == "decimal":
        return 100 * 10 ** min(9, max(0, kind.precision - kind.scale))
    if what != "text":
        return 10**30
    room = DOMAINS.get(rule, 10**30)
    if max_len:  # fixed beginnings, then hexadecimal or decimal digits
        head, base, most = {"email": (5, 16, 16), "phone": (5, 10, 7), "govid": (0, 16, 11), "secret": (9, 16, 12)}.get(rule, (0, 0, 0))
        if base:
            room = min(room, base ** min(most, max(0, max_len - head)) + (rule == "secret" and max_len >= head))
    return room


def _settled(tries: DataFrame, order: list[str], names: list[str]) -> DataFrame:
    """(order, names, _salt): which of its tries each row gets, by deferred acceptance.

    A row wants its lowest salt; of the rows that want a value it goes to the lowest salt, then the
    first in order, and the others give that try up, until no value is wanted twice. The outcome is
    that of trying salt after salt, since a later salt never takes a value from an earlier one.
    """
    place = F.struct(*order)
    while True:
        wish = tries.groupBy(*order).agg(F.min(F.struct("_salt", *names)).alias("_w")).select(*order, "_w.*")
        best = wish.groupBy(*names).agg(F.min(F.struct(F.col("_salt"), place.alias("_place"))).alias("_b"), F.count("*").alias("_n"))
        lost, n = counted(wish.join(best.where("_n > 1"), names).where((F.col("_b._salt") != F.col("_salt")) | (F.col("_b._place") != place)).select(*order, "_salt"), "unique-lost")
        if not n:
            return materialise(wish, "unique-won")
        tries = materialise(tries.join(lost, [*order, "_salt"], "left_anti"), "unique")


def mask_unique(df: DataFrame, columns: list[str], rules: dict[str, str], order: list[str], seed: str, **types) -> DataFrame:
    """``df`` with ``columns`` masked so that their values stay unique together.

    Every row starts with salt 0; of rows with equal masked values the first in ``order`` (a key)
    keeps its own, the others try the next salt, against each other and all values kept before.
    They try blocks of salts that double in size, so passes grow with the logarithm of the salts needed.
    Rows with a null in a column are exempt. ``types`` maps a column to keyword arguments of mask.
    Only rows whose masked value occurs twice go into the passes; each is decided by a minimum for
    each value and joins on the key, so a value that all rows share (a constant rule) is no hot group.
    """
    def masked(rows: DataFrame, salt) -> list:
        return [mask(F.col(c), rules[c], df.schema[c].dataType, seed, salt=salt, **types.get(c, {})).alias(f"_m{i}") for i, c in enumerate(columns)]

    names = [f"_m{i}" for i in range(len(columns))]
    whole = df.where(" and ".join(f"`{c}` is not null" for c in columns)).select(*order, *columns)
    room = 1
    for c in columns:
        room *= 10**30 if rules[c] == "keep" else domain(rules[c], df.schema[c].dataType, types.get(c, {}).get("max_len"))
    if room < 10**30 and whole.count() > room:
        raise ModelError(f"{columns} hold more values than the rules {[rules[c] for c in columns]} can give")
    at_first = whole.select(*order, *masked(whole, 0))
    place = F.struct(*order)
    twice, n = counted(at_first.groupBy(*names).agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(*names, "_first"), "unique")
    put = {c: mask(F.col(c), rules[c], df.schema[c].dataType, seed, salt=F.col("_salt"), **types.get(c, {})) for c in columns}
    if not n:
        return df.withColumn("_salt", F.lit(0)).withColumns(put).select(*df.columns)
    losers = at_first.join(twice, names).where(place != F.col("_first")).select(*order)
    pending = materialise(whole.join(losers, order, "left_semi"), "unique-left")
    won: list[DataFrame] = []
    lo = 1
    while lo <= MAX_SALT:
        block = range(lo, min(MAX_SALT, 2 * lo + SALTS - 2) + 1)
        tries = pending.select(*order, F.inline(F.array(*(F.struct(F.lit(s).alias("_salt"), *masked(pending, s)) for s in block))))
        for kept in (at_first, *won):
            tries = tries.join(kept.select(*names), names, "left_anti")
        now = _settled(materialise(tries, "unique"), order, names)
        won.append(now)
        pending, left = counted(pending.join(now.select(*order), order, "left_anti"), "unique-left")
        if not left:
            break
        lo = block[-1] + 1
    else:
        raise ModelError(f"no {MAX_SALT} salts keep {columns} unique under {[rules[c] for c in columns]}")
    found = reduce(DataFrame.unionByName, won).select(*order, "_salt")
    return df.join(found, order, "left").withColumn("_salt", F.coalesce("_salt", F.lit(0))).withColumns(put).select(*df.columns)


def mask_table(model: RelationalModel, table: str, seed: str, classifier: Classifier | None = None, df: DataFrame | None = None) -> DataFrame:
    """A table (or a slice of it) with the rules applied to every column that is no key.

    One projection masks all columns; declared unique sets with a masked column are repaired after;
    generated columns are computed again from what the masked columns hold.
    """
    classifier, t = classifier or Classifier(), model.table(table)
    df = t.df if df is None else df
    keys = model.key_columns(table)
    rule_of = {c: "keep" if c in keys or c in t.generated else classifier.rule(table, c) for c in df.columns}
    types = {c: {"tag": t.kinds.get(c), "max_len": t.max_len.get(c), "nullable": _nullable(t, c)} for c in df.columns}
    for u in t.uniques:
        check_unique_rule(t, u, rule_of | dict.fromkeys(set(u) - set(rule_of), "keep"))
    sets = [u for u in t.uniques if t.pk and set(u) <= set(df.columns) and any(rule_of[c] not in ("keep", "redact") for c in u)]
    repaired = {c for u in sets for c in u}
    for u in sets:
        df = mask_unique(df, list(u), rule_of, list(t.pk), seed, **{c: types[c] for c in u})
    plain = [c for c in df.columns if c not in repaired and c not in t.generated]
    out = df.select(*(F.col(c) if c in repaired else mask(F.col(c), rule_of[c], df.schema[c].dataType, seed, **types[c]).alias(c)
                      for c in df.columns if c in repaired or c in plain))
    return recompute_generated(out, t)


def recompute_generated(df: DataFrame, t: TableSpec) -> DataFrame:
    """Generated columns from their expressions over the (masked) columns, in the table's order."""
    return df.withColumns({c: F.expr(e) for c, e in t.generated.items()}).select(*(c for c in t.df.columns if c in df.columns or c in t.generated))


def maskable_schema(schema: StructType, rules: dict[str, str]) -> None:
    """Raise for a rule on a type without substitutes."""
    for f in schema:
        if rules.get(f.name, "keep") not in ("keep", "redact") and kind_of(f.dataType) == "other":
            raise UnsupportedType(f"{f.name}: rule {rules[f.name]} can't mask {f.dataType.simpleString()}")
