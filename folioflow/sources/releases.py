"""Releases: complete folders of tables, an active one that a pointer names, and a ledger from which a crash is recovered.

Activation has three steps, each a file that is written at once: an intent in the ledger
(with the release that is active before), the pointer, and the intent's outcome. Ledger
entries are numbered and never overwritten, so of two writers one gets an error. Whatever
step a writer dies after, ``recover`` sees from the pointer whether the intent took effect
and writes its outcome.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.sources.store import manifest

INTENT, DONE, DROPPED, TORN = "intent", "done", "dropped", "torn"


class ReleaseError(RuntimeError):
    """A release or its ledger isn't in a state in which the step may be taken."""


class Releases:
    """Releases under ``root``, a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("ledger"))

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _write(self, name: str, value: dict, *, over: bool = False) -> None:
        """Put a small file in place at once: it is written beside and renamed, over an older one only if told so."""
        body = bytearray(json.dumps(value, sort_keys=True).encode() + b"\n")
        if not over:
            try:
                out = self._fs.create(self._path(name), False)
            except Exception as error:
                raise ReleaseError(f"{name} is there already; another writer was faster") from error
            out.write(body)
            out.close()
            return
        beside = self._path(f"{name}.next")
        out = self._fs.create(beside, True)
        out.write(body)
        out.close()
        options = self.spark._sc._gateway.new_array(self._hadoop.fs.Options.Rename, 1)
        options[0] = self._hadoop.fs.Options.Rename.OVERWRITE
        context = self._hadoop.fs.FileContext.getFileContext(self._path(name).toUri() if "://" in self.root else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(beside, self._path(name), options)

    def _read(self, name: str) -> dict | None:
        path = self._path(name)
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            raw = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        try:
            return json.loads(raw)
        except ValueError:
            return {}  # a writer died within the file

    def stage(self, name: str, tables: dict[str, DataFrame]) -> None:
        """Write a release's tables and, last, its manifest; a name is used once."""
        if self._read(f"releases/{name}/manifest.json") is not None:
            raise ReleaseError(f"release {name} is there already")
        facts = {}
        for table, rows in tables.items():
            path = f"{self.root}/releases/{name}/{table}"
            rows.write.mode("overwrite").parquet(path)  # an earlier try may have died
            row = manifest(self.spark.read.schema(rows.schema).parquet(path), table).first()
            facts[table] = {"n": row["n"], "content": str(row["content"])}
        self._write(f"releases/{name}/manifest.json", {"release": name, "tables": facts})

    def verify(self, name: str) -> None:
        """Count and hash a release's tables again."""
        stored = self._read(f"releases/{name}/manifest.json")
        if not stored:
            raise ReleaseError(f"release {name} is not complete")
        for table, fact in stored["tables"].items():
            row = manifest(self.table(table, name), table).first()
            if {"n": row["n"], "content": str(row["content"])} != fact:
                raise ReleaseError(f"table {table} of release {name} has changed")

    def table(self, table: str, name: str | None = None) -> DataFrame:
        """A table of a release, by default of the active one."""
        name = name or self.active()
        if name is None:
            raise ReleaseError("no release is active")
        return self.spark.read.parquet(f"{self.root}/releases/{name}/{table}")

    def active(self) -> str | None:
        pointer = self._read("current.json")
        return pointer["release"] if pointer else None

    def entries(self) -> list[dict]:
        """The ledger in order; it has a few rows per activation. An entry within which a writer died is torn."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("ledger")))
        return [self._read(f"ledger/{n}") or {"step": TORN} for n in names if n.endswith(".json")]

    def _append(self, number: int, **entry) -> None:
        self._write(f"ledger/{number:012d}.json", {"number": number, **entry})

    def activate(self, name: str) -> None:
        """Make a complete release the active one. An activation left open by another writer is recovered first."""
        self.recover()
        self.verify(name)
        number, before = len(self.entries()), self.active()
        self._append(number, step=INTENT, release=name, before=before)
        self._write("current.json", {"release": name, "number": number}, over=True)
        self._append(number + 1, step=DONE, release=name, before=before)

    def rollback(self) -> str:
        """Activate the release that was active before the active one; returns its name."""
        self.recover()
        history = [e for e in self.entries() if e.get("step") == DONE]
        stack: list[str] = []
        for e in history:  # going back takes the last one off, anything else comes on top
            if len(stack) > 1 and stack[-2] == e["release"] and e["before"] == stack[-1]:
                stack.pop()
            else:
                stack.append(e["release"])
        if len(stack) < 2:
            raise ReleaseError("there is no release to go back to")
        self.activate(stack[-2])
        return stack[-2]

    def recover(self) -> str | None:
        """Close an activation that a writer has left open; returns its outcome, None if there was none.

        If the pointer names the intent's release it is done, if it names the one before it
        is dropped. A pointer that is gone (on storage where a rename over a file isn't one
        step) is written again. A pointer that names anything else is an error.
        """
        found = self.entries()
        number, whole = len(found), [e for e in found if e["step"] != TORN]
        if not whole or whole[-1]["step"] != INTENT:
            return None  # a torn intent took no effect: the pointer is written after it
        last = whole[-1]
        pointer = self._read("current.json")
        if pointer and pointer["release"] == last["release"] and pointer.get("number") == last["number"]:
            outcome = DONE
        elif pointer and pointer["release"] == last["before"] or pointer is None and last["before"] is None:
            outcome = DROPPED
        elif not pointer:
            self.verify(last["release"])
            self._write("current.json", {"release": last["release"], "number": last["number"]}, over=True)
            outcome = DONE
        else:
            raise ReleaseError(f"the pointer names {pointer['release']}, neither side of the open activation")
        self._append(number, step=outcome, release=last["release"], before=last["before"])
        return outcome


def ledger_states(entries: DataFrame, lane: str, number: str, step: Column, release: Column) -> DataFrame:
    """(lane, active, activated_at, pending, activations, dropped, faults) of ledgers that are tables.

    An outcome counts for the intent right before it in its lane; others are faults. active
    is the release of the last intent that was done, pending that of an intent at the end.
    Null lanes are a lane; a lane without an intent has neither. Rows meet sorted by lane
    and number, in windows that spill; numbers don't repeat within a lane.
    """
    over = Window.partitionBy(lane).orderBy(number)
    rows = entries.select(lane, number, step.alias("_step"), release.alias("_release"))
    rows = rows.withColumns({"_last": F.lag("_step").over(over), "_intended": F.lag("_release").over(over), "_next": F.lead("_step").over(over)})
    outcome = F.col("_step").isin(DONE, DROPPED)
    met = outcome & F.coalesce(F.col("_last") == INTENT, F.lit(False))
    done = met & (F.col("_step") == DONE)
    return rows.groupBy(lane).agg(
        F.max_by("_intended", F.when(done, F.col(number))).alias("active"),
        F.max(F.when(done, F.col(number))).alias("activated_at"),
        F.max(F.when((F.col("_step") == INTENT) & F.col("_next").isNull(), F.col("_release"))).alias("pending"),
        F.count_if(done).alias("activations"),
        F.count_if(met & (F.col("_step") == DROPPED)).alias("dropped"),
        F.count_if(outcome & ~met).alias("faults"),
    )
