"""Versions of tables' schemas: steps with hashes, a ledger of those applied, and reading an old version as a new one.

A step adds, renames, widens or drops a column. Steps form a chain: each version's hash is
over its step and the hash before, so a step that was changed after it was applied is seen.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Types that hold every value of the type before them.
WIDER = {"tinyint": ("smallint", "int", "bigint"), "smallint": ("int", "bigint"), "int": ("bigint", "double"), "float": ("double",), "date": ("timestamp",)}


class SchemaFault(ValueError):
    """A step that doesn't fit its table, or a ledger that isn't that of the steps."""


@dataclass(frozen=True)
class Step:
    """``kind`` is add (column, type, default), rename (column, to), widen (column, type) or drop (column)."""

    table: str
    kind: str
    column: str
    type: str | None = None
    to: str | None = None
    default: str | None = None

    def applied(self, rows: DataFrame) -> DataFrame:
        """The table after this step, as a plan over the table before it."""
        names = rows.columns
        if self.kind == "add":
            if self.column in names:
                raise SchemaFault(f"{self.table} has {self.column} already")
            return rows.withColumn(self.column, F.lit(self.default).cast(self.type))
        if self.column not in names:
            raise SchemaFault(f"{self.table} has no {self.column}")
        if self.kind == "rename":
            if self.to in names:
                raise SchemaFault(f"{self.table} has {self.to} already")
            return rows.withColumnRenamed(self.column, self.to)
        if self.kind == "drop":
            return rows.drop(self.column)
        if self.kind == "widen":
            held = rows.schema[self.column].dataType.simpleString()
            if self.type not in WIDER.get(held, ()):
                raise SchemaFault(f"{self.table}.{self.column} can't be widened from {held} to {self.type}")
            return rows.withColumn(self.column, F.col(self.column).cast(self.type))
        raise SchemaFault(f"unknown kind of step {self.kind}")


class Schema:
    """The first version of each table and the steps since then; version n is that after n steps."""

    def __init__(self, spark: SparkSession, first: dict[str, str], steps: list[Step]):
        self.spark, self.first, self.steps = spark, first, steps

    @property
    def version(self) -> int:
        return len(self.steps)

    def hashes(self) -> list[str]:
        """The hash of every version from 0 on."""
        out = [hashlib.sha256(json.dumps(self.first, sort_keys=True).encode()).hexdigest()]
        for step in self.steps:
            out.append(hashlib.sha256((out[-1] + json.dumps(asdict(step), sort_keys=True, ensure_ascii=False)).encode()).hexdigest())
        return out

    def ledger(self, version: int | None = None) -> DataFrame:
        """(version, sha256, step) up to a version: what a store that is at it keeps. It has a row per step."""
        version = self.version if version is None else version
        told = [json.dumps(self.first, sort_keys=True), *(json.dumps(asdict(s), sort_keys=True, ensure_ascii=False) for s in self.steps)]
        return self.spark.createDataFrame(list(zip(range(version + 1), self.hashes(), told, strict=False)), "version int, sha256 string, step string")

    def faults(self, ledger: DataFrame) -> list[str]:
        """What of a store's ledger isn't that of these steps: a gap, a changed or unknown version. None: it may be read and migrated."""
        held = {r["version"]: r["sha256"] for r in ledger.collect()}
        wanted = dict(enumerate(self.hashes()))
        out = [f"version {v} is unknown" for v in sorted(held) if v not in wanted]
        out += [f"version {v} has changed" for v in sorted(held) if v in wanted and held[v] != wanted[v]]
        return out + [f"version {v} is missing" for v in range(max(held, default=-1) + 1) if v not in held]

    def read(self, table: str, rows: DataFrame, version: int) -> DataFrame:
        """``rows`` of a table that were written at ``version``, in today's form. Nothing is written."""
        for step in self.steps[version:]:
            if step.table == table:
                rows = step.applied(rows)
        return rows

    def expected(self, table: str, version: int | None = None) -> StructType:
        """The columns of a table at a version."""
        columns = _parse_datatype_string(self.first[table])
        empty = self.spark.createDataFrame([], StructType([StructField(f.name, f.dataType) for f in columns]))
        for step in self.steps[: self.version if version is None else version]:
            if step.table == table:
                empty = step.applied(empty)
        return empty.schema


class VersionedTables:
    """Tables under ``root``, a folder for each version; the newest one with a ledger is the store's."""

    def __init__(self, schema: Schema, root: str):
        self.schema, self.root = schema, root.rstrip("/")
        self.spark = schema.spark

    def _held(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [int(n.removeprefix("v")) for n in names if n.startswith("v")]
        return sorted(v for v in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v{v:06d}/ledger/_SUCCESS")))

    def create(self, tables: dict[str, DataFrame], version: int = 0) -> None:
        """Write tables in the form of ``version``, their ledger last: without it a version isn't there."""
        for name, rows in tables.items():
            wanted = [(f.name, f.dataType) for f in self.schema.expected(name, version)]
            if [(f.name, f.dataType) for f in rows.schema] != wanted:
                raise SchemaFault(f"{name} isn't in the form of version {version}")
            rows.write.mode("overwrite").parquet(f"{self.root}/v{version:06d}/{name}")
        self.schema.ledger(version).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/v{version:06d}/ledger")

    def open(self, table: str) -> DataFrame:
        """A table in today's form, whatever version is stored; a ledger of other steps is an error."""
        held = self._held()
        if not held:
            raise SchemaFault("there is no store")
        at = held[-1]
        if found := self.schema.faults(self.spark.read.parquet(f"{self.root}/v{at:06d}/ledger")):
            raise SchemaFault("; ".join(found))
        return self.schema.read(table, self.spark.read.schema(self.schema.expected(table, at)).parquet(f"{self.root}/v{at:06d}/{table}"), at)

    def migrate(self) -> int:
        """Write all tables in today's form; again it does nothing. Returns the version before. The old version stays."""
        before = self._held()[-1:] or [None]
        if before[0] is None:
            raise SchemaFault("there is no store")
        if before[0] != self.schema.version:
            self.create({name: self.open(name) for name in self.schema.first}, self.schema.version)
        return before[0]
