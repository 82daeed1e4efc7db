"""SQL scripts as a data source: statements made by Spark, files by partition writers, published by the commit.

``df.write.format("sqlscript")`` takes (section, statement_no, statement). Every partition writes a file for
each section that it holds, named by a number of its own and reported in its commit message; the driver's
commit lists the files of successful tasks, in order, in a manifest, and a failed job's abort deletes
them. So a task that is tried again, or a job that fails, leaves nothing that counts. Reading the format
gives the statements back, a partition for each file.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.literals import identifier, sql_literal
from ..model import ModelError, RelationalModel, TableSpec
from ..operators.loading import LoadPlan
from ..operators.ranking import global_row_number

BATCH = 500  # rows of one INSERT or UPDATE
MANIFEST = "_script.json"
SHAPE = "section string, statement_no long, statement string"
_QUOTES = re.compile(r"""'|"|;\n""")


def _numbered(df: DataFrame, order: list[str], columns: list[str], batch: int) -> DataFrame:
    """(statement_no, tuples): the literals of ``batch`` rows in order, one after another."""
    literals = F.concat(F.lit("("), F.concat_ws(", ", *(sql_literal(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns)), F.lit(")"))
    rows = global_row_number(df.select(*dict.fromkeys([*order, *([] if order else columns)]), literals.alias("_tuple")), order or columns)
    grouped = rows.groupBy(F.floor((F.col("_n") - 1) / batch).cast("long").alias("statement_no")).agg(
        F.array_sort(F.collect_list(F.struct("_n", "_tuple"))).alias("r"))
    return grouped.select("statement_no", F.array_join("r._tuple", ", ").alias("tuples"))


def _place(schema: str, table: str) -> str:
    return f"{identifier(schema)}.{identifier(table)}"


def insert_statements(df: DataFrame, t: TableSpec, schema: str = "public", batch: int = BATCH) -> DataFrame:
    """(statement_no, statement): one INSERT for each ``batch`` rows in key order."""
    columns = [c for c in df.columns if c not in t.generated]
    override = " OVERRIDING SYSTEM VALUE" if t.identity_always & set(columns) else ""
    head = f"INSERT INTO {_place(schema, t.name)} ({', '.join(map(identifier, columns))}){override} VALUES "
    rows = _numbered(df, list(t.pk), columns, batch)
    return rows.select("statement_no", F.concat(F.lit(head), "tuples", F.lit(";")).alias("statement"))


def update_statements(rows: DataFrame, t: TableSpec, schema: str = "public", batch: int = BATCH) -> DataFrame:
    """(statement_no, statement): UPDATEs that put the deferred columns' values in, ``batch`` rows each."""
    pk, columns = list(t.pk), [c for c in rows.columns if c not in t.pk]
    names = ", ".join(map(identifier, [*pk, *columns]))
    sets = ", ".join(f"{identifier(c)} = v.{identifier(c)}" for c in columns)
    same = " AND ".join(f"t.{identifier(c)} = v.{identifier(c)}" for c in pk)
    out = _numbered(rows, pk, [*pk, *columns], batch)
    return out.select("statement_no", F.concat(F.lit(f"UPDATE {_place(schema, t.name)} AS t SET {sets} FROM (VALUES "), "tuples", F.lit(f") AS v ({names}) WHERE {same};")).alias("statement"))


def sequence_reset(t: TableSpec, column: str, schema: str = "public") -> str:
    """The statement that puts an owned sequence behind the loaded rows."""
    place, c = _place(schema, t.name), identifier(column)
    text = lambda x: "'" + x.replace("'", "''") + "'"
    return f"SELECT setval(pg_get_serial_sequence({text(place)}, {text(column)}), COALESCE(MAX({c}), 1), MAX({c}) IS NOT NULL) FROM {place};"


class ScriptSink:
    """A load as a script: begin, a section of INSERTs for each table in load order, then the UPDATEs of what was deferred,
    the sequences, and the end of the transaction. Nothing is written before the whole load is known; the
    data source then writes it by one job."""

    def __init__(self, path: str, schema: str = "public", overwrite: bool = False):
        self.path, self.schema, self.overwrite = path, schema, overwrite

    def open(self, model: RelationalModel, plan: LoadPlan) -> None:
        self.model, self.plan, self.parts, self.tables = model, plan, [], []

    def _add(self, name: str, statements: DataFrame) -> None:
        self.parts.append(statements.select(F.lit(f"{len(self.parts) + 1:03d}-{name}").alias("section"), "statement_no", "statement"))

    def write(self, table: str, image: DataFrame) -> None:
        self.tables.append(table)
        self._add(f"insert-{table}", insert_statements(image, self.model.table(table), self.schema))

    def deferred(self, table: str, rows: DataFrame) -> None:
        self._add(f"update-{table}", update_statements(rows, self.model.table(table), self.schema))

    def close(self) -> None:
        spark = self.parts[0].sparkSession
        begin = ["BEGIN;", *(["SET CONSTRAINTS ALL DEFERRED;"] if self.plan.constraints_deferred else [])]
        resets = [sequence_reset(self.model.table(t), c, self.schema) for t in self.tables for c in self.model.table(t).sequences]
        fixed = [("000-begin", i, s) for i, s in enumerate(begin)] + [(f"{len(self.parts) + 1:03d}-sequences", i, s) for i, s in enumerate(resets)] + [("999-commit", 0, "COMMIT;")]
        script = reduce(DataFrame.unionByName, [*self.parts, spark.createDataFrame(fixed, SHAPE)])
        register(spark)
        dealt = script.repartitionByRange("section", "statement_no").sortWithinPartitions("section", "statement_no")
        dealt.write.format("sqlscript").mode("overwrite" if self.overwrite else "append").save(self.path)

    def abort(self) -> None:
        """Nothing was written yet, or the data source has deleted it."""


@dataclass
class Written(WriterCommitMessage):
    """(section, first statement's number, file, statements) of what a task wrote."""

    files: list[tuple[str, int, str, int]]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The path's file system, local where it names none."""
    plain = re.sub(r"^file:/*", "/", path)
    return (fs.LocalFileSystem(), plain.rstrip("/")) if plain.startswith("/") else fs.FileSystem.from_uri(path)


class ScriptWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        files, root = _open(self.path)
        out, stream, section = [], None, None
        try:
            for row in iterator:
                if row.section != section:
                    if stream:
                        stream.close()
                    section, name = row.section, f"{self.job}/{uuid.uuid4().hex}.sql"
                    files.create_dir(f"{root}/{self.job}", recursive=True)
                    stream = files.open_output_stream(f"{root}/{name}")
                    out.append([section, row.statement_no, name, 0])
                stream.write((row.statement + "\n").encode())
                out[-1][3] += 1
        finally:
            if stream:
                stream.close()
        return Written([tuple(x) for x in out])

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        there = files.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound
        if there and not self.overwrite:
            self.abort(messages)
            raise ModelError(f"{self.path} has a script already")
        listed = sorted(x for m in messages if m for x in m.files)
        before = json.loads(files.open_input_stream(f"{root}/{MANIFEST}").read()) if there else []
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{MANIFEST}.{self.job}") as stream:
            stream.write(json.dumps(listed).encode())
        files.move(f"{root}/{MANIFEST}.{self.job}", f"{root}/{MANIFEST}")
        for job in {x[2].split("/")[0] for x in before}:
            files.delete_dir(f"{root}/{job}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        if files.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.job}")


@dataclass
class ScriptFile(InputPartition):
    section: str
    first: int
    name: str


def statements_of(lines: Iterator[str]) -> Iterator[str]:
    """Statements that end with a semicolon at a line's end, outside quotes."""
    held, quote = [], ""
    for line in lines:
        held.append(line)
        for m in _QUOTES.finditer(line):
            if m[0] == ";\n":
                if not quote:
                    yield "".join(held).removesuffix("\n")
                    held = []
            elif not quote or quote == m[0]:
                quote = "" if quote else m[0]
    if "".join(held).strip():
        yield "".join(held)


class ScriptReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[ScriptFile]:
        files, root = _open(self.path)
        listed = json.loads(files.open_input_stream(f"{root}/{MANIFEST}").read())
        return [ScriptFile(section, first, name) for section, first, name, _ in listed] or [ScriptFile("", 0, "")]

    def read(self, partition: ScriptFile) -> Iterator[tuple]:
        if not partition.name:
            return
        files, root = _open(self.path)
        with files.open_input_stream(f"{root}/{partition.name}") as stream:
            for i, statement in enumerate(statements_of(_lines(stream))):
                yield partition.section, partition.first + i, statement


def _lines(stream, size: int = 1 << 20) -> Iterator[str]:
    rest = b""
    while block := stream.read(size):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x.decode() + "\n" for x in whole)
    if rest:
        yield rest.decode()


class SqlScript(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlscript"

    def schema(self) -> str:
        return SHAPE

    def writer(self, schema: StructType, overwrite: bool) -> ScriptWriter:
        if {"section", "statement_no", "statement"} - set(schema.names):
            raise ModelError("a script needs section, statement_no and statement")
        return ScriptWriter(self.options["path"], overwrite)

    def reader(self, schema: StructType) -> ScriptReader:
        return ScriptReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqlScript)


def read_script(spark: SparkSession, path: str) -> DataFrame:
    """(section, statement_no, statement) of a published script."""
    register(spark)
    return spark.read.format("sqlscript").load(path)
