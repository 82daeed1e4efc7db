"""Referential integrity: orphans, cycles, and relationships nobody declared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..model import ForeignKey, ModelError, RelationalModel


EXACT = 14  # tables of a group whose best order is found exactly


class OrphanFound(AssertionError):
    """A reference without its parent."""


def orphans(model: RelationalModel, fk: ForeignKey) -> DataFrame:
    """Child rows (key and reference) whose reference is not null and has no parent."""
    child, parent = model.table(fk.child), model.table(fk.parent)
    rows = child.rows().where(fk.when) if fk.when else child.rows()
    rows = rows.where(" and ".join(f"`{c}` is not null" for c in fk.columns))
    refs = [f"_r{i}" for i in range(len(fk.columns))]
    own = rows.select(*child.key, *(F.col(c).alias(r) for c, r in zip(fk.columns, refs)))
    there = parent.df.select(*(F.col(c).alias(r) for c, r in zip(fk.ref_columns, refs)))
    return own.join(there, refs, "left_anti")


def orphan_counts(model: RelationalModel) -> DataFrame:
    """(fk, n_orphans) of every relationship."""
    out = [orphans(model, fk).agg(F.count("*").alias("n_orphans")).select(F.lit(fk.name).alias("fk"), "n_orphans") for fk in model.fks]
    return reduce(DataFrame.unionByName, out)


def assert_referential(model: RelationalModel) -> None:
    bad = orphan_counts(model).where("n_orphans > 0").collect()
    if bad:
        raise OrphanFound("; ".join(f"{r.fk}: {r.n_orphans}" for r in bad))


def break_cycle(df: DataFrame, pk: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The insert image with ``columns`` null, and the (key, columns) rows to restore."""
    image = df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns})
    return image, df.where(" or ".join(f"`{c}` is not null" for c in columns)).select(*pk, *columns)


def restore_cycle(image: DataFrame, deferred: DataFrame, pk: list[str], columns: list[str]) -> DataFrame:
    kept = deferred.select(*pk, *(F.col(c).alias(f"_d_{c}") for c in columns))
    out = image.join(kept, pk, "left")
    return out.withColumns({c: F.coalesce(f"_d_{c}", c) for c in columns}).select(*image.columns)


def reference_counts(model: RelationalModel, fks: list[ForeignKey]) -> DataFrame:
    """(fk, n_rows, n_set): rows of the child, and those whose reference is set."""
    out = []
    for fk in fks:
        used = " and ".join(f"`{c}` is not null" for c in fk.columns)
        out.append(model.table(fk.child).df.agg(F.count("*").alias("n_rows"), F.count(F.when(F.expr(used), 1)).alias("n_set")).select(F.lit(fk.name).alias("fk"), "n_rows", "n_set"))
    return reduce(DataFrame.unionByName, out)


def cycle_links(model: RelationalModel) -> DataFrame | None:
    """(cycle, fk, table_name, columns, deferrable, may_be_null, n_rows, n_set) of the relationships on cycles; None without any.

    A cycle is named by its tables; a self-reference is a cycle of its own.
    """
    member = {t: "+".join(g) for g in model.cycles() for t in g}
    on = [(member[f.child] if f.child != f.parent else f.child, f) for f in model.fks if member.get(f.child) and member.get(f.child) == member.get(f.parent)]
    if not on:
        return None
    rows = [(c, f.name, f.child, list(f.columns), f.deferrable, not set(f.columns) & model.table(f.child).not_null_columns(), bool(model.table(f.child).pk)) for c, f in on]
    spark = model.table(on[0][1].child).df.sparkSession
    known = spark.createDataFrame(rows, "cycle string, fk string, table_name string, columns array<string>, deferrable boolean, may_be_null boolean, has_key boolean")
    return known.join(reference_counts(model, [f for _, f in on]), "fk")


def least_feedback(tables: list[str], weights: dict[tuple[str, str], float]) -> set[tuple[str, str]]:
    """The arcs (child, parent) of least total weight without which the tables can be put in an order.

    Up to EXACT tables by the best order of each subset: the last of a subset pays for its arcs from
    tables in front of it. Above, cycles pay their least arc until none is left, and arcs that were
    paid for without need come back, the heaviest first.
    """
    if len(tables) > EXACT:
        return _local_ratio(tables, weights)
    n = len(tables)
    place = {t: i for i, t in enumerate(tables)}
    costs = [[0.0] * n for _ in range(n)]  # of arc i -> j: i waits for j
    for (child, parent), w in weights.items():
        costs[place[child]][place[parent]] += w
    best, last = [0.0] * (1 << n), [0] * (1 << n)
    for s in range(1, 1 << n):
        inside = [i for i in range(n) if s >> i & 1]
        best[s], last[s] = min((best[s & ~(1 << v)] + sum(costs[i][v] for i in inside if i != v), v) for v in inside)
    order, s = [], (1 << n) - 1
    while s:
        order.append(last[s])
        s &= ~(1 << last[s])
    at = {tables[v]: n - k for k, v in enumerate(order)}
    return {(c, p) for c, p in weights if c != p and at[c] < at[p]}


def _local_ratio(tables: list[str], weights: dict[tuple[str, str], float]) -> set[tuple[str, str]]:
    left = {a: w for a, w in weights.items() if a[0] != a[1]}
    gone: set[tuple[str, str]] = set()
    while cycle := _a_cycle(tables, set(left)):
        least = min(left[a] for a in cycle)
        for a in cycle:
            left[a] -= least
            if left[a] <= 0 or left[a] != left[a]:  # infinity less infinity
                gone.add(a)
                del left[a]
    for a in sorted(gone, key=lambda a: (-weights[a], a)):
        if not _a_cycle(tables, {*left, a}):
            left[a] = weights[a]
    return {a for a in weights if a[0] != a[1] and a not in left}


def _a_cycle(tables: list[str], arcs: set[tuple[str, str]]) -> list[tuple[str, str]]:
    """The arcs of some cycle; none if there is none."""
    after = {t: sorted(p for c, p in arcs if c == t) for t in tables}
    done: set[str] = set()
    for start in tables:
        path, todo = [], [(start, iter(after[start]))] if start not in done else []
        while todo:
            t, rest = todo[-1]
            if not path or path[-1] != t:
                path.append(t)
            step = next((p for p in rest if p not in done), None)
            if step is None:
                done.add(t)
                todo.pop()
                path.pop()
            elif step in path:
                ring = [*path[path.index(step):], step]
                return list(zip(ring, ring[1:]))
            else:
                todo.append((step, iter(after[step])))
    return []


def break_candidates(model: RelationalModel) -> DataFrame | None:
    """(cycle, table_name, columns, fk, n_deferred, blockers): the references to load as null and restore later.

    Of each group of tables that reach each other the references whose removal leaves no cycle, of
    all such choices the one with the fewest rows to restore; self-references are cycles of their
    own. Only references that may be null, of tables with a primary key, can be chosen; ``blockers``
    are the group's relationships that can't be deferred. None if there is no cycle or all of their
    constraints can be deferred; a cycle that can't be broken is an error.
    """
    links = cycle_links(model)
    if links is None:
        return None
    rows = sorted(links.collect(), key=lambda r: r.fk)  # as many as the schema has relationships on cycles
    parent = {f.name: f.parent for f in model.fks}
    out = []
    for cycle in sorted({r.cycle for r in rows}):
        mine = [r for r in rows if r.cycle == cycle]
        blockers = [r.fk for r in mine if not r.deferrable]
        if not blockers:
            continue
        weights: dict[tuple[str, str], float] = {}
        for r in mine:
            arc = r.table_name, parent[r.fk]
            weights[arc] = weights.get(arc, 0) + (r.n_set if r.may_be_null and r.has_key else float("inf"))
        arcs = set(weights) if all(c == p for c, p in weights) else least_feedback(sorted({t for a in weights for t in a}), weights)
        chosen = [r for r in mine if (r.table_name, parent[r.fk]) in arcs]
        if any(not (r.may_be_null and r.has_key) for r in chosen):
            raise ModelError(f"the cycle {cycle} can't be broken: " + ("its table has no primary key" if any(r.may_be_null for r in mine if not r.has_key) else "no reference may be null"))
        out += [(cycle, r.table_name, r["columns"], r.fk, r.n_set, blockers) for r in chosen]
    spark = next(iter(model.tables.values())).df.sparkSession
    shape = "cycle string, table_name string, columns array<string>, fk string, n_deferred long, blockers array<string>"
    return spark.createDataFrame(out, shape) if out else None


def soft_keys(model: RelationalModel) -> DataFrame:
    """(table_name, column_name, guess, type_column, inclusion): columns that look like references nobody declared.

    A column `<base>_id` that no key and no relationship covers. Tables whose name is the base, or
    its plural, are candidates; the guess is the one that has the largest share of the column's
    distinct values among its key's (``inclusion``; null for a column without values), then the
    first by name. A column `<base>_type` beside it makes it polymorphic.
    """
    spark = next(iter(model.tables.values())).df.sparkSession
    covered = {(f.child, c) for f in model.fks for c in f.columns} | {(t.name, c) for t in model.tables.values() for c in t.pk}
    columns = spark.createDataFrame([(t.name, c) for t in model.tables.values() if not t.partition_of for c in t.df.columns if (t.name, c) not in covered], "table_name string, column_name string")
    base = F.regexp_extract(F.lower("column_name"), "^(.+)_id$", 1)
    place = F.regexp_extract("table_name", r"^(.*?)[^.]*$", 1)  # the schema and its dot
    asked = columns.select("*", base.alias("base"), place.alias("place")).where("base <> ''")
    types = columns.select("table_name", F.col("column_name").alias("type_column"), F.regexp_extract("column_name", "^(.+)_type$", 1).alias("base"))
    targets = spark.createDataFrame([(t.name,) for t in model.tables.values() if len(t.pk) == 1 and not t.partition_of], "guess string").select(
        "guess", F.regexp_extract("guess", r"^(.*?)[^.]*$", 1).alias("place"), F.regexp_extract("guess", r"([^.]*)$", 1).alias("n"))
    named = targets.select("guess", "place", F.explode(F.array("n", F.regexp_replace("n", "s$", ""), F.regexp_replace("n", "es$", ""))).alias("base")).distinct()
    pairs = asked.join(named, ["base", "place"])
    asked_for = [(r.table_name, r.column_name, r.guess, model.table(r.guess).pk[0]) for r in pairs.collect()]  # as many as the schema has such names
    share = inclusions(model, asked_for).select("table_name", "column_name", "guess", F.col("ratio").alias("inclusion"))
    best = pairs.join(share, ["table_name", "column_name", "guess"], "left").groupBy("table_name", "column_name").agg(
        F.min(F.struct((-F.coalesce("inclusion", F.lit(0.0))).alias("less"), "guess", "inclusion")).alias("b"))
    return (asked.join(best, ["table_name", "column_name"], "left").join(types, ["table_name", "base"], "left")
            .select("table_name", "column_name", "b.guess", "type_column", "b.inclusion"))


def _cells(model: RelationalModel, columns: set[tuple[str, str]], role: str, number: dict[tuple[str, str], int]) -> list[DataFrame]:
    """(role, column, v) of the distinct values of columns: one scan for each table that has some."""
    out = []
    for t in sorted({t for t, _ in columns}):
        df = model.table(t).df
        as_text = lambda c: (F.col(f"`{c}`").cast("decimal(38,10)") if isinstance(df.schema[c].dataType, NumericType) else F.col(f"`{c}`")).cast("string")  # noqa: B023, E731
        cells = F.array(*(F.struct(F.lit(number[t, c]).alias("column"), as_text(c).alias("v")) for _, c in sorted(x for x in columns if x[0] == t)))
        out.append(df.select(F.inline(cells)).where("v is not null").distinct().select(F.lit(role).alias("role"), "column", "v"))
    return out


def inclusions(model: RelationalModel, pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """(table_name, column_name, guess, n_distinct, n_contained, ratio) of pairs (child, column, parent, its column), all at once.

    An inverted index from value to the columns that have it: each table is read once for its
    columns, whose distinct values meet in one shuffle; a value then has at most a row for each
    column of the schema, so none is hot. Numbers compare by value across types (to ten decimals).
    A pair whose child column has no value has no row.
    """
    spark = next(iter(model.tables.values())).df.sparkSession
    shape = "table_name string, column_name string, guess string, n_distinct long, n_contained long, ratio double"
    if not pairs:
        return spark.createDataFrame([], shape)
    asking, asked = {(a, b) for a, b, _, _ in pairs}, {(c, d) for _, _, c, d in pairs}
    number = {x: i for i, x in enumerate(sorted(asking | asked))}
    index = reduce(DataFrame.unionByName, [*_cells(model, asking, "child", number), *_cells(model, asked, "parent", number)]).groupBy("v").agg(
        F.collect_set(F.when(F.col("role") == "child", F.col("column"))).alias("children"), F.collect_set(F.when(F.col("role") == "parent", F.col("column"))).alias("parents"))
    wanted = spark.createDataFrame([(a, b, c, number[a, b], number[c, d]) for a, b, c, d in pairs], "table_name string, column_name string, guess string, child int, parent int")
    held = index.select(F.explode("children").alias("child"), "parents").join(F.broadcast(wanted), "child")  # a row for each pair of the schema
    return held.groupBy("table_name", "column_name", "guess").agg(
        F.count("*").alias("n_distinct"), F.count(F.when(F.array_contains("parents", F.col("parent")), 1)).alias("n_contained")).withColumn("ratio", F.col("n_contained") / F.col("n_distinct"))


def inclusion_profile(model: RelationalModel, child: str, column: str, parent: str, ref_column: str, by: str | None = None) -> DataFrame:
    """How many distinct values of a column are values of a possible parent's, for each ``by`` value."""
    keys = [F.col(by).alias("discriminator")] if by else [F.lit(None).cast("string").alias("discriminator")]
    own = model.table(child).df.where(f"`{column}` is not null").select(*keys, F.col(column).alias("v")).distinct()
    there = model.table(parent).df.select(F.col(ref_column).alias("v"), F.lit(1).alias("_in")).distinct()
    counted = own.join(there, "v", "left").groupBy("discriminator").agg(F.count("*").alias("n_distinct"), F.count("_in").alias("n_contained"))
    return counted.withColumn("ratio", F.col("n_contained") / F.col("n_distinct"))


def edges(model: RelationalModel) -> DataFrame:
    """(child, parent, fk, is_virtual, n_references): relationships and how many child rows use them."""
    out = []
    for fk in model.fks:
        used = " and ".join(f"`{c}` is not null" for c in fk.columns)
        rows = model.table(fk.child).df.where(f"({fk.when}) and {used}" if fk.when else used)
        out.append(rows.agg(F.count("*").alias("n_references")).select(
            F.lit(fk.child).alias("child"), F.lit(fk.parent).alias("parent"), F.lit(fk.name).alias("fk"), F.lit(fk.virtual).alias("is_virtual"), "n_references"))
    return reduce(DataFrame.unionByName, out)


# Table names that suit as a root.
PREFERRED_ROOTS = ("users", "user", "accounts", "account", "customers", "customer", "organizations")


def suggest_root(model: RelationalModel) -> DataFrame:
    """(table_name, score, n_rows), best first: relationships that point at a table, and 100 for a usual root."""
    out = []
    for t in model.tables.values():
        if not t.partition_of:
            score = len(model.children(t.name)) + (100 if t.name.rpartition(".")[2].lower() in PREFERRED_ROOTS else 0)
            out.append(t.df.agg(F.count("*").alias("n_rows")).select(F.lit(t.name).alias("table_name"), F.lit(score).cast("long").alias("score"), "n_rows"))
    return reduce(DataFrame.unionByName, out).orderBy(F.desc("score"), "table_name")
