"""All-or-nothing writes: tables are staged, and a manifest that names them is published last.

A target folder has data folders and a log of numbered manifests. A manifest says which data folders
make up each table; readers take the one with the highest number, so they see a load wholly or not at
all. Two loads that started from the same version can't both publish: the second one's rename finds the
number taken. Folders that no manifest names are leftovers of failed loads, which ``vacuum`` deletes.

The log goes through Hadoop's file system API by Spark's gateway (not there on Spark Connect).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import ModelError, RelationalModel
from ..operators.loading import LoadPlan, restored_rows

LOG = "_log"


class ConflictError(ModelError):
    """Another load was published since this one began."""


@dataclass
class Part:
    """A table's rows, or those of its deferred columns, in the folders that hold them."""

    folders: list[str]
    schema: dict
    n_rows: int


@dataclass
class Manifest:
    version: int = 0
    tables: dict[str, Part] = field(default_factory=dict)
    deferred: dict[str, Part] = field(default_factory=dict)


class Files:
    """The few operations on a shared file system that a commit needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm, self.conf, self.root = spark, spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Put a whole file at its place at once, unless there is one."""
        draft = f"{LOG}/.{uuid.uuid4().hex}"
        self.write(draft, text)
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.fs.makeQualified(self.path(draft)), self.fs.makeQualified(self.path(name)), none)
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self.delete(draft)
            return False

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def current(spark: SparkSession, path: str) -> Manifest:
    """The published state of a target; an empty one of version 0 where nothing was."""
    files = Files(spark, path)
    versions = [n for n in files.names(LOG) if n.endswith(".json") and not n.startswith(".")]
    if not versions:
        return Manifest()
    raw = json.loads(files.read(f"{LOG}/{versions[-1]}"))
    parts = lambda x: {t: Part(**p) for t, p in x.items()}
    return Manifest(raw["version"], parts(raw["tables"]), parts(raw["deferred"]))


def _frame(spark: SparkSession, path: str, part: Part) -> DataFrame:
    return spark.read.schema(StructType.fromJson(part.schema)).parquet(*(f"{path.rstrip('/')}/{f}" for f in part.folders))


def read_images(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The insert images of a target's tables, and the rows of their deferred columns."""
    state = current(spark, path)
    frames = lambda parts: {t: _frame(spark, path, p) for t, p in parts.items()}
    return frames(state.tables), frames(state.deferred)


def read_tables(spark: SparkSession, model: RelationalModel, path: str) -> dict[str, DataFrame]:
    """A target's tables with deferred columns restored."""
    images, later = read_images(spark, path)
    return {t: restored_rows(model, t, df, later.get(t)) for t, df in images.items()}


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete data folders that the published state doesn't name; their names come back. No load may run meanwhile."""
    files, state = Files(spark, path), current(spark, path)
    used = {f for p in [*state.tables.values(), *state.deferred.values()] for f in p.folders}
    gone = []
    for run in files.names():
        if run.startswith("data-"):
            for name in files.names(run):
                if f"{run}/{name}" not in used:
                    files.delete(f"{run}/{name}")
                    gone.append(f"{run}/{name}")
            if not files.names(run):
                files.delete(run)
    return gone


class ParquetSink:
    """A load into a folder of Parquet tables, of which readers see all or nothing.

    ``overwrite`` replaces what is there, ``append`` adds and refuses keys that are there,
    ``errorifexists`` refuses tables that are there.
    """

    def __init__(self, spark: SparkSession, path: str, mode: str = "errorifexists"):
        if mode not in ("errorifexists", "append", "overwrite"):
            raise ModelError(f"no such mode: {mode}")
        self.spark, self.path, self.mode = spark, path.rstrip("/"), mode
        self.files, self.run = Files(spark, self.path), f"data-{uuid.uuid4().hex}"

    def open(self, model: RelationalModel, plan: LoadPlan) -> None:
        self.model, self.base = model, current(self.spark, self.path)
        taken = sorted(set(plan.order) & set(self.base.tables)) if self.mode == "errorifexists" else []
        if taken:
            raise ModelError(f"tables exist in the target: {', '.join(taken)}")
        keep = self.base if self.mode != "overwrite" else Manifest()
        self.next = Manifest(self.base.version + 1, dict(keep.tables), dict(keep.deferred))

    def _stage(self, parts: dict[str, Part], table: str, name: str, df: DataFrame) -> None:
        folder, seen = f"{self.run}/{name}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/{folder}")
        old = parts.get(table, Part([], {}, 0))
        if old.folders and StructType.fromJson(old.schema).simpleString() != df.schema.simpleString():
            raise ModelError(f"{table}: the target has other columns")
        parts[table] = Part([*old.folders, folder], df.schema.jsonValue(), old.n_rows + seen.get["n"])

    def write(self, table: str, image: DataFrame) -> None:
        before = self.next.tables.get(table)
        self._stage(self.next.tables, table, table, image)
        pk = list(self.model.table(table).pk)
        if self.mode == "append" and pk and before:
            mine = _frame(self.spark, self.path, Part(self.next.tables[table].folders[-1:], image.schema.jsonValue(), 0))
            if not _frame(self.spark, self.path, before).select(*pk).join(mine.select(*pk), pk, "left_semi").isEmpty():
                raise ModelError(f"{table}: keys are in the target already")

    def deferred(self, table: str, rows: DataFrame) -> None:
        self._stage(self.next.deferred, table, f"{table}.deferred", rows)

    def close(self) -> None:
        if not self.files.publish(f"{LOG}/{self.next.version:020d}.json", json.dumps(asdict(self.next))):
            raise ConflictError(f"version {self.next.version} of {self.path} was published by another load")

    def abort(self) -> None:
        self.files.delete(self.run)
