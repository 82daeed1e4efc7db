"""Loading a slice whose tables reference each other: waves, insert images, and what is restored afterwards."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ForeignKey, RelationalModel
from .integrity import break_candidates, break_cycle, restore_cycle


@dataclass
class LoadPlan:
    """Tables by wave: those of a wave reference earlier waves only, but for ``deferred``, columns that are restored at the end.

    ``constraints_deferred``: cycles are left to constraints that are all checked at commit.
    """

    waves: list[list[str]]
    deferred: dict[str, list[str]] = field(default_factory=dict)
    breaks: list[ForeignKey] = field(default_factory=list)
    constraints_deferred: bool = False

    @property
    def order(self) -> list[str]:
        return [t for wave in self.waves for t in wave]


def load_plan(model: RelationalModel) -> LoadPlan:
    """The waves of a load and the references that have to wait, chosen by how many rows have them."""
    found = break_candidates(model)
    chosen = {r.fk for r in found.collect()} if found is not None else set()
    breaks = [f for f in model.fks if f.name in chosen]
    waits = {t: {c for f in breaks if f.child == t for c in f.columns} for t in {f.child for f in breaks}}
    deferred = {t: [c for c in model.table(t).df.columns if c in columns] for t, columns in sorted(waits.items())}
    held = [set(g) for g in model.cycles()]
    within = [f for f in model.fks if f not in breaks and any(f.child in g and f.parent in g for g in held)]
    free = [f for f in within if f.deferrable and _all_deferrable(model, f, held)]
    return LoadPlan(model.levels([*breaks, *free]), deferred, breaks, bool(free))


def _all_deferrable(model: RelationalModel, fk: ForeignKey, groups: list[set[str]]) -> bool:
    group = next(g for g in groups if fk.child in g and fk.parent in g)
    return all(f.deferrable for f in model.fks if f.child in group and f.parent in group and (f.child == f.parent) == (fk.child == fk.parent))


def insert_image(model: RelationalModel, plan: LoadPlan, table: str, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows to insert, deferred columns null, and the (key, columns) rows to restore, if any wait."""
    columns = plan.deferred.get(table)
    return break_cycle(df, list(model.table(table).pk), columns) if columns else (df, None)


def restored_rows(model: RelationalModel, table: str, image: DataFrame, later: DataFrame | None) -> DataFrame:
    if later is None:
        return image
    pk = list(model.table(table).pk)
    return restore_cycle(image, later, pk, [c for c in later.columns if c not in pk])


def unmet_references(model: RelationalModel, plan: LoadPlan, frames: dict[str, DataFrame]) -> DataFrame:
    """(wave, table_name, fk, n_unmet) of a load by waves: references of a table's insert image whose parent isn't loaded before.

    A relationship within a wave, a table's own one but for itself included, has no parent loaded before;
    a self-reference that doesn't wait is met by the statement that inserts both rows.
    """
    wave = {t: i for i, ts in enumerate(plan.waves) for t in ts}
    out = []
    for fk in model.fks:
        if fk.child not in frames or fk.parent not in frames or fk.child == fk.parent and fk.child not in plan.deferred:
            continue
        refs = [f"_r{i}" for i in range(len(fk.columns))]
        image = insert_image(model, plan, fk.child, frames[fk.child])[0]
        image = image.where(fk.when) if fk.when else image
        own = image.where(" and ".join(f"`{c}` is not null" for c in fk.columns)).select(*(F.col(c).alias(r) for c, r in zip(fk.columns, refs)))
        there = frames[fk.parent].select(*(F.col(c).alias(r) for c, r in zip(fk.ref_columns, refs)))
        left = own if wave[fk.parent] >= wave[fk.child] else own.join(there, refs, "left_anti")
        out.append(left.agg(F.count("*").alias("n_unmet")).select(F.lit(wave[fk.child]).alias("wave"), F.lit(fk.child).alias("table_name"), F.lit(fk.name).alias("fk"), "n_unmet"))
    return reduce(DataFrame.unionByName, out)


class Sink(Protocol):
    """Where a load goes: opened once, given each table's image in load order, then what was deferred, then closed or aborted."""

    def open(self, model: RelationalModel, plan: LoadPlan) -> None: ...

    def write(self, table: str, image: DataFrame) -> None: ...

    def deferred(self, table: str, rows: DataFrame) -> None: ...

    def close(self) -> None: ...

    def abort(self) -> None: ...


def load(model: RelationalModel, frames: dict[str, DataFrame], sink: Sink, plan: LoadPlan | None = None) -> LoadPlan:
    """Hand a slice to a sink, wave by wave, then the deferred rows; any failure aborts the sink and goes on to the caller."""
    specs = {t: model.table(t) for t in frames}
    own = RelationalModel([type(s)(**{**s.__dict__, "df": frames[t]}) for t, s in specs.items()], [f for f in model.fks if f.child in frames and f.parent in frames])
    plan = plan or load_plan(own)
    try:
        sink.open(own, plan)
        waiting = []
        for t in plan.order:
            image, later = insert_image(own, plan, t, frames[t])
            sink.write(t, image)
            if later is not None:
                waiting.append((t, later))
        for t, later in waiting:
            sink.deferred(t, later)
        sink.close()
    except BaseException:
        sink.abort()
        raise
    return plan
