"""Row selection and the foreign-key closure over key sets."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Protocol
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ForeignKey, ModelError, RelationalModel
from ..scratch import counted, forget, materialise
from . import filters
from .filters import ValueFilter
from .ranking import global_row_number

ROOT_LIMIT, CHILD_LIMIT = 1000, 100_000


@dataclass(frozen=True)
class SliceSize:
    limit: int
    child_depth: int


#: The slice-size presets.
PRESETS = {"small": SliceSize(1_000, 1), "medium": SliceSize(10_000, 1), "large": SliceSize(100_000, 2)}


def preset_estimates(model: RelationalModel, root: str, where: str | None = None) -> DataFrame:
    """(preset, root_rows, estimated_rows): what each preset would take, before any closure is run.

    Of the rows of ``root`` under the condition the preset's limit; each deeper level by the mean
    number of children that a parent row has, all from counts.
    """
    t = model.table(root)
    n_root = (t.df.where(where) if where else t.df).agg(F.count("*").alias("n_root"))
    sizes = {x: model.table(x).df.agg(F.count("*").alias(f"_n_{x}")) for x in model.tables}
    out = []
    for name, size in PRESETS.items():
        facts, level, total = n_root.withColumn("root_rows", F.least("n_root", F.lit(size.limit))), {t.name: F.col("root_rows").cast("double")}, F.col("root_rows").cast("double")
        needed: set[str] = set()
        for _ in range(size.child_depth):
            below: dict[str, Column] = {}
            for table, rows in level.items():
                for fk in model.children(table):
                    needed |= {fk.child, table}
                    more = rows * F.col(f"_n_{fk.child}") / F.greatest(F.col(f"_n_{table}"), F.lit(1))
                    below[fk.child] = below[fk.child] + more if fk.child in below else more
            level = below
            for rows in below.values():
                total = total + rows
        for x in sorted(needed):
            facts = facts.join(sizes[x])  # one row each
        out.append(facts.select(F.lit(name).alias("preset"), F.col("root_rows").cast("long").alias("root_rows"), F.round(total).cast("long").alias("estimated_rows")))
    return reduce(DataFrame.unionByName, out)


def fit_preset(model: RelationalModel, root: str, most_rows: int, where: str | None = None) -> str:
    """The largest preset whose estimate is within ``most_rows``; the smallest if none is."""
    rows = {r.preset: r.estimated_rows for r in preset_estimates(model, root, where).collect()}
    return next((p for p in reversed(PRESETS) if rows[p] <= most_rows), next(iter(PRESETS)))


def in_sample(key: list[str], percent: float) -> Column:
    """Deterministic hash sample of keys, to a hundredth of a percent."""
    if not 0 <= percent <= 100:
        raise ValueError("sample_percent must be from 0 to 100")
    text = F.concat_ws(":", *(F.col(c).cast("string") for c in key))
    return F.pmod(F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long"), F.lit(10_000)) < percent * 100


def root_keys(model: RelationalModel, root: str, where: str | None = None, limit: int | None = ROOT_LIMIT,
              sample_percent: float | None = None, required: bool = False) -> DataFrame:
    """Keys of root rows under a SQL condition, a hash sample and a limit (the first by key).

    A limit of zero or less is the default one, None is none. ``required`` raises if none match.
    """
    t = model.table(root)
    keys = (t.rows().where(where) if where else t.rows()).select(*t.key)
    if sample_percent is not None:
        keys = keys.where(in_sample(list(t.key), sample_percent))
    if limit is not None:
        keys = keys.orderBy(*t.key).limit(limit if limit > 0 else ROOT_LIMIT)
    if required and keys.isEmpty():
        raise ModelError(f"no rows of {root} match")
    return keys


def _child_rows(model: RelationalModel, fk: ForeignKey) -> DataFrame:
    rows = model.table(fk.child).rows()
    if fk.when:
        rows = rows.where(fk.when)
    return rows.where(" and ".join(f"`{c}` is not null" for c in fk.columns))


def parent_keys(model: RelationalModel, fk: ForeignKey, keys: DataFrame) -> DataFrame:
    """Distinct keys of the parents that the child rows with ``keys`` reference."""
    child, parent = model.table(fk.child), model.table(fk.parent)
    refs = _child_rows(model, fk).join(keys, list(child.key), "left_semi").select(
        *(F.col(c).alias(f"_r{i}") for i, c in enumerate(fk.columns))).distinct()
    rows = parent.rows().select(*parent.key, *(F.col(c).alias(f"_r{i}") for i, c in enumerate(fk.ref_columns)))
    return rows.join(refs, [f"_r{i}" for i in range(len(fk.columns))], "left_semi").select(*parent.key).distinct()


def child_keys(model: RelationalModel, fk: ForeignKey, keys: DataFrame, child_limit: int | None = None) -> DataFrame:
    """Distinct keys of the children that reference the parent rows with ``keys``.

    ``child_limit`` caps the children of each parent, the first by child key staying; a limit of
    zero or less is the default one.
    """
    child, parent = model.table(fk.child), model.table(fk.parent)
    names = [f"_r{i}" for i in range(len(fk.columns))]
    refs = parent.rows().join(keys, list(parent.key), "left_semi").select(
        *(F.col(c).alias(n) for c, n in zip(fk.ref_columns, names))).distinct()
    rows = _child_rows(model, fk).select(*child.key, *(F.col(c).alias(n) for c, n in zip(fk.columns, names)))
    rows = rows.join(refs, names, "left_semi")
    return capped(rows, names, list(child.key), child_limit).select(*child.key).distinct()


def capped(rows: DataFrame, values: list[str], key: list[str], limit: int | None) -> DataFrame:
    """Of each value's rows the first ``limit`` by key; the default limit for zero or less, all for None.

    Rows are counted for each value first, which aggregates before anything moves, and only values
    with more than the limit are put in order: over all of them by range partitions of (value, key),
    so the rows of one value lie in as many tasks as they need. Values that go over are not null.
    """
    if limit is None:
        return rows
    limit = limit if limit > 0 else CHILD_LIMIT
    over, n = counted(rows.groupBy(*values).agg(F.count("*").alias("_many")).where(F.col("_many") > limit).select(*values), "capped")
    if not n:
        return rows
    hot = rows.join(over, values, "left_semi").select(*rows.columns)
    numbered = global_row_number(hot, list(dict.fromkeys([*values, *key])), "_nth")
    first = materialise(numbered.groupBy(*values).agg(F.min("_nth").alias("_first")), "capped-first")
    kept = numbered.join(first, values).where(F.col("_nth") - F.col("_first") < limit).select(*rows.columns)
    return rows.join(over, values, "left_anti").select(*rows.columns).unionByName(kept)


def link_view(model: RelationalModel, table: str) -> DataFrame:
    """What the closure needs of a table: key, the columns of its relationships, and whether each ``when`` holds."""
    t = model.table(table)
    columns = {c for fk in model.parents(table) for c in fk.columns} | {c for fk in model.children(table) for c in fk.ref_columns}
    held = [F.coalesce(F.expr(fk.when), F.lit(False)).alias(_when(fk)) for fk in model.parents(table) if fk.when]
    return t.rows().select(*t.key, *sorted(columns - set(t.key)), *held)


def link_rows(model: RelationalModel, table: str) -> DataFrame:
    """The link view, read anew by pruned scans where there is a primary key; else the rows' digests are made once and written."""
    rows = link_view(model, table)
    return rows if model.table(table).pk else materialise(rows, f"links-{table}")


def _when(fk: ForeignKey) -> str:
    return f"_when{crc32(f'{fk.name} {fk.when}'.encode())}"


def referencing(model: RelationalModel, fk: ForeignKey, rows: DataFrame) -> DataFrame:
    """The rows among ``link_rows`` of the child that use the relationship."""
    used = [F.col(c).isNotNull() for c in fk.columns] + ([F.col(_when(fk))] if fk.when else [])
    return rows.where(reduce(lambda a, b: a & b, used))


def _values(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"_r{i}") for i, c in enumerate(columns))).distinct()


def _with_values(rows: DataFrame, columns: tuple[str, ...], values: DataFrame, n: int) -> DataFrame:
    """The rows that have one of the values, of which there are ``n`` at most.

    Where they are too many for a broadcast join but not for a bitmap, most other rows are left out
    before anything is shuffled.
    """
    refs = [f"_r{i}" for i in range(len(columns))]
    if filters.FEW <= n <= filters.MANY and all(rows.schema[c].dataType == values.schema[r].dataType for c, r in zip(columns, refs)):
        rows = ValueFilter(values, refs, n).keep(rows, list(columns))
    same = reduce(lambda a, b: a & b, (rows[c] == values[r] for c, r in zip(columns, refs)))
    return rows.join(values, same, "left_semi")


class ChildIndex(Protocol):
    """Where child rows are kept by what they reference; None for a relationship without an index."""

    def children(self, fk: ForeignKey) -> list[DataFrame] | None: ...


def closure(model: RelationalModel, root: str, keys: DataFrame, child_depth: int = 1, child_limit: int | None = CHILD_LIMIT, index: ChildIndex | None = None) -> dict[str, DataFrame]:
    """The key sets of a referentially complete slice: (key columns, depth, via) for each table.

    Parents keep the depth of the row that needs them and are followed to the end; children of the
    rows found at a depth below ``child_depth`` are one deeper. Levels are finished one after the
    other, so ``depth`` is the least possible; ``via`` is the first by name of the relationships
    that found the key in that round. Only new keys expand, so cyclic schemas end. Each round's
    keys are written to the shared folder with the values of their relationships, so a step joins
    those with the other side only; the tables of a round are written side by side. ``index`` has
    child rows by what they reference, which spares a child step the scan and shuffle of its table.
    """
    root = model.table(root).name
    links: dict[str, DataFrame] = {}
    seen: dict[str, list[DataFrame]] = {}
    sizes: dict[int, int] = {}  # rows of the rounds' tables, by the frame's identity

    def rows_of(table: str) -> DataFrame:
        if table not in links:
            links[table] = link_rows(model, table)
        return links[table]

    def write(table: str, sets: list[DataFrame], depth: int) -> tuple[str, DataFrame, int]:
        key = list(model.table(table).key)
        others = [c for c in link_view(model, table).columns if c not in key]
        new = reduce(DataFrame.unionByName, sets).groupBy(*key).agg(F.min("via").alias("via"), *(F.first(c).alias(c) for c in others))
        if table in seen:
            new = new.join(reduce(DataFrame.unionByName, seen[table]).select(*key), key, "left_anti")
        return table, *counted(new.withColumn("depth", F.lit(depth)), f"keys-{table}")

    def fresh(found: dict[str, list[DataFrame]], depth: int) -> dict[str, DataFrame]:
        out = {}
        with ThreadPoolExecutor(4) as pool:
            for table, new, n in pool.map(lambda x: write(*x, depth), sorted(found.items(), key=lambda x: x[0])):
                if n:
                    out[table], sizes[id(new)] = new, n
                    seen.setdefault(table, []).append(new)
        return out

    def first(sets: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, sets)

    start = rows_of(root).join(keys.select(*model.table(root).key), list(model.table(root).key), "left_semi")
    frontier = fresh({root: [start.withColumn("via", F.lit("root"))]}, 0)
    for depth in range(child_depth + 1):
        level: dict[str, list[DataFrame]] = {}
        while frontier:
            found: dict[str, list[DataFrame]] = {}
            for table, new in frontier.items():
                level.setdefault(table, []).append(new)
                for fk in model.parents(table):
                    above = _with_values(rows_of(fk.parent), fk.ref_columns, _values(referencing(model, fk, new), fk.columns), sizes[id(new)])
                    found.setdefault(fk.parent, []).append(above.withColumn("via", F.lit(fk.name)))
            frontier = fresh(found, depth)
        if depth < child_depth:
            found = {}
            for table, sets in level.items():
                for fk in model.children(table):
                    held = index.children(fk) if index else None
                    values = _values(first(sets), fk.ref_columns)
                    n = sum(sizes[id(x)] for x in sets)
                    below = first([_with_values(rows, fk.columns, values, n) for rows in held or [referencing(model, fk, rows_of(fk.child))]])
                    below = capped(below, list(fk.columns), list(model.table(fk.child).key), child_limit)
                    found.setdefault(fk.child, []).append(below.withColumn("via", F.lit(fk.name)))
            frontier = fresh(found, depth + 1)
    for table, rows in links.items():
        if not model.table(table).pk:
            forget(rows)
    return {t: first(sets).select(*model.table(t).key, "depth", "via") for t, sets in sorted(seen.items())}


def parent_closure(model: RelationalModel, root: str, keys: DataFrame) -> dict[str, DataFrame]:
    return closure(model, root, keys, child_depth=0)


def keyset_counts(keys: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_keys) of a closure, before any row is read."""
    counts = [k.agg(F.count("*").alias("n_keys")).select(F.lit(t).alias("table_name"), "n_keys") for t, k in keys.items()]
    return reduce(DataFrame.unionByName, counts)


def save_keys(keys: dict[str, DataFrame], path: str) -> None:
    """Keep complete key sets for later runs."""
    for t, k in keys.items():
        k.write.mode("overwrite").parquet(f"{path}/{t}")


def load_keys(spark, path: str, tables: list[str]) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{path}/{t}") for t in tables}


def read_slice(model: RelationalModel, keys: DataFrame, table: str) -> DataFrame:
    """The insertable columns of the rows with ``keys``; repeated rows of a keyless table all come.

    Most rows that are not in the slice are left out in the scan (``filters``) where the keys are too many for a broadcast.
    """
    t = model.table(table)
    rows, wanted = t.rows(), keys.select(*t.key)
    n = wanted.count()  # of a closure's keys read from the files' footers
    if filters.FEW <= n <= filters.MANY and all(rows.schema[c].dataType == wanted.schema[c].dataType for c in t.key):
        rows = ValueFilter(wanted, list(t.key), n).keep(rows, list(t.key))
    return rows.join(wanted, list(t.key), "left_semi").select(*t.insert_columns())
