"""The relational model: tables, keys and relationships declared over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_ID = "_row_id"


class ModelError(ValueError):
    """The declared model doesn't fit the data or itself."""


@dataclass(frozen=True)
class ForeignKey:
    """Ordered child columns that reference ordered parent columns.

    ``when`` restricts the child rows by a SQL condition (polymorphic relationships); ``virtual``
    marks a relationship that the source doesn't enforce.
    """

    child: str
    columns: tuple[str, ...]
    parent: str
    ref_columns: tuple[str, ...]
    when: str | None = None
    virtual: bool = False
    deferrable: bool = False

    @property
    def signature(self) -> tuple:
        return self.child, self.columns, self.parent, self.ref_columns, self.when

    @property
    def name(self) -> str:
        return f"{self.child}({','.join(self.columns)})->{self.parent}({','.join(self.ref_columns)})"


@dataclass
class TableSpec:
    """A table's data and what Parquet can't say about it. Without ``pk`` whole rows identify."""

    name: str
    df: DataFrame
    pk: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    not_null: frozenset[str] = frozenset()
    max_len: dict[str, int] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)  # column -> uuid, inet or json, for strings
    generated: dict[str, str] = field(default_factory=dict)  # column -> SQL expression
    identity_always: frozenset[str] = frozenset()
    sequences: tuple[str, ...] = ()
    partition_of: str | None = None

    @property
    def key(self) -> tuple[str, ...]:
        return self.pk or (ROW_ID,)

    def rows(self) -> DataFrame:
        """The data, with a digest of the whole row as identity where there is no primary key."""
        if self.pk:
            return self.df
        cells = []
        for f in self.df.schema:
            c = F.col(f"`{f.name}`")
            text = F.to_json(F.struct(c)) if f.dataType.typeName() in ("array", "map", "struct", "variant") else F.base64(c) if f.dataType.typeName() == "binary" else c.cast("string")
            cells.append(F.coalesce(F.concat_ws(":", F.length(text).cast("string"), text), F.lit("")))
            cells[-1] = F.when(c.isNull(), F.lit("-")).otherwise(cells[-1])
        return self.df.withColumn(ROW_ID, F.md5(F.concat(*cells).cast("binary")))

    def insert_columns(self) -> list[str]:
        """The columns a load writes: all but stored generated ones."""
        return [c for c in self.df.columns if c not in self.generated]

    def not_null_columns(self) -> set[str]:
        return set(self.not_null) | set(self.pk)


class RelationalModel:
    def __init__(self, tables: list[TableSpec], fks: list[ForeignKey] = ()):
        self.tables = {t.name: t for t in sorted(tables, key=lambda t: t.name)}
        logical = {t.name: t.partition_of for t in tables if t.partition_of}
        seen: dict[tuple, ForeignKey] = {}
        for fk in fks:
            child, parent = self.full_name(fk.child), self.full_name(fk.parent)
            fk = ForeignKey(logical.get(child, child), fk.columns, logical.get(parent, parent), fk.ref_columns, fk.when, fk.virtual, fk.deferrable)
            seen.setdefault(fk.signature, fk)
        self.fks = sorted(seen.values(), key=lambda f: f.name)
        self._validate()

    def _validate(self) -> None:
        for t in self.tables.values():
            for c in {*t.pk, *t.generated, *t.max_len, *t.not_null, *(x for u in t.uniques for x in u)} - set(t.df.columns):
                raise ModelError(f"{t.name} has no column {c}")
        for fk in self.fks:
            for name, columns in ((fk.child, fk.columns), (fk.parent, fk.ref_columns)):
                if name not in self.tables:
                    raise ModelError(f"{fk.name}: no table {name}")
                for c in columns:
                    if c not in self.tables[name].df.columns:
                        raise ModelError(f"{fk.name}: {name} has no column {c}")
            if len(fk.columns) != len(fk.ref_columns):
                raise ModelError(f"{fk.name}: columns don't pair up")

    def full_name(self, name: str) -> str:
        """The table's name with its schema, which may be left out where only one table is called so."""
        if name in self.tables:
            return name
        found = [t for t in self.tables if t.rpartition(".")[2] == name]
        if len(found) > 1:
            raise ModelError(f"{name} may be any of {', '.join(found)}")
        return found[0] if found else name

    def table(self, name: str) -> TableSpec:
        name = self.full_name(name)
        if name not in self.tables:
            raise ModelError(f"no table {name}")
        return self.tables[name]

    def parents(self, table: str) -> list[ForeignKey]:
        return [f for f in self.fks if f.child == table]

    def children(self, table: str) -> list[ForeignKey]:
        return [f for f in self.fks if f.parent == table]

    def key_columns(self, table: str) -> set[str]:
        """Primary-key columns and both sides of all relationships, virtual ones too: never masked."""
        own = {c for f in self.parents(table) for c in f.columns}
        return set(self.table(table).pk) | own | {c for f in self.children(table) for c in f.ref_columns}

    def levels(self, breaks: list[ForeignKey] = ()) -> list[list[str]]:
        """Tables by level, each sorted: those of a level reference earlier levels only.

        Relationships in ``breaks`` and self-references don't count; a cycle that is left is an error.
        """
        skip = {f.signature for f in breaks}
        waits = {t: {f.parent for f in self.parents(t) if f.signature not in skip and f.parent != t} for t in self.tables}
        out, done = [], set()
        while waits:
            ready = sorted(t for t, w in waits.items() if w <= done)
            if not ready:
                raise ModelError(f"a cycle is left among {', '.join(sorted(waits))}: break one of its relationships")
            out.append(ready)
            done |= set(ready)
            for t in ready:
                del waits[t]
        return out

    def load_order(self, breaks: list[ForeignKey] = ()) -> list[str]:
        """Tables, parents first; relationships in ``breaks`` and self-references don't count."""
        return [t for level in self.levels(breaks) for t in level]

    def cycles(self) -> list[list[str]]:
        """Groups of tables that reach each other, each sorted; self-references count.

        Strongly connected components in one walk: a table's low mark is the earliest table on the
        walk's stack that it reaches, and one that reaches nothing earlier closes a group.
        """
        after = {t: sorted({f.parent for f in self.parents(t)}) for t in self.tables}
        seen: dict[str, int] = {}
        low: dict[str, int] = {}
        stack, on, groups = [], set(), []
        for start in self.tables:
            todo = [(start, iter(after[start]))] if start not in seen else []
            while todo:
                t, rest = todo[-1]
                if t not in seen:
                    seen[t] = low[t] = len(seen)
                    stack.append(t)
                    on.add(t)
                step = next((p for p in rest if p not in seen or p in on), None)
                if step is None:
                    todo.pop()
                    if todo:
                        low[todo[-1][0]] = min(low[todo[-1][0]], low[t])
                    if low[t] == seen[t]:
                        group = stack[stack.index(t):]
                        del stack[len(stack) - len(group):]
                        on -= set(group)
                        if len(group) > 1 or t in after[t]:
                            groups.append(sorted(group))
                elif step in seen:
                    low[t] = min(low[t], seen[step])
                else:
                    todo.append((step, iter(after[step])))
        return sorted(groups)
