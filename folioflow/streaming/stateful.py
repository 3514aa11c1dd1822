"""The rules of commands and leases over streams, with state kept by key and timers that end leases."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from folioflow.operators.commands import Command, CommandRules, Lease, LeaseRules

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = "group string, seq long, outcome string, command long"
ENDED = "board string, runner string, since long, until long, beats long, refused long, ended string"


def use_state_store(spark: SparkSession) -> None:
    """State with timers needs the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one batch in order of time; a batch holds what has come since the last one."""
    frames = list(rows)
    return (frames[0] if len(frames) == 1 else pd.concat(frames)).sort_values(["at", "seq"])


def _none(value):
    return None if value is None or value != value else value


class Commands(StatefulProcessor):
    """One conflict group: its command, and the command accepted under each key (on disk, as long as the stream lives)."""

    def __init__(self, rules: CommandRules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getValueState("active", "state string, command long, runner string, expires long, until long, claims int")
        self.known = handle.getMapState("known", "key string", "command long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        found = self.active.get()
        state = Command(*found) if found else Command()
        known, out = {}, []  # what is known of this batch's keys; a group that is new has none on disk
        for row in _ordered(rows).itertuples():
            create, name = row.kind == "create", _none(row.key)
            if create and found and name is not None and name not in known and self.known.containsKey((name,)):
                known[name] = self.known.getValue((name,))[0]
            before = known.get(name) if create else None
            command = _none(row.command)
            state, outcome, about = self.rules.decide(state, row.at, row.kind, None if command is None else int(command), _none(row.runner), before)
            if create and outcome == "accepted" and name is not None:
                self.known.updateValue((name,), (about,))
                known[name] = about
            out.append((key[0], row.seq, outcome, about))
        self.active.update(tuple(asdict(state).values()))
        groups, seqs, outcomes, about = zip(*out, strict=True)
        yield pd.DataFrame({"group": groups, "seq": seqs, "outcome": outcomes, "command": pd.array(about, dtype="Int64")})

    def close(self) -> None:
        pass


class Leases(StatefulProcessor):
    """One board: its lease, and a timer at the lease's end."""

    def __init__(self, rules: LeaseRules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "runner string, since long, until long, beats long, refused long")

    def _load(self) -> Lease:
        found = self.lease.get()
        return Lease(*found) if found else Lease()

    def _store(self, before: Lease, now: Lease) -> None:
        """Keep the lease and move its timer (milliseconds, rounded up) to its end."""
        if before.runner is not None and before.until != now.until:
            self.handle.deleteTimer(-(-before.until // 1000))
        if now.runner is None:
            self.lease.clear()
            return
        self.lease.update(tuple(asdict(now).values()))
        if before.runner is None or before.until != now.until:
            self.handle.registerTimer(-(-now.until // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        before = now = self._load()
        out = []
        for row in _ordered(rows).itertuples():
            now, ended = self.rules.decide(now, row.at, row.kind, _none(row.runner))
            out += [(key[0], *e) for e in ended]
        self._store(before, now)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ENDED.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        before = self._load()
        now, ended = self.rules.expire(before, expiredTimerInfo.getExpiryTimeInMs() * 1000)
        if ended:
            self.lease.clear()
        yield pd.DataFrame([(key[0], *e) for e in ended], columns=[c.split()[0] for c in ENDED.split(", ")])

    def close(self) -> None:
        pass


def _schema(spark: SparkSession, ddl: str) -> StructType:
    return spark.createDataFrame([], ddl).schema


def command_stream(events: DataFrame, rules: CommandRules | None = None) -> DataFrame:
    """``commands.command_outcomes`` over a stream: columns as there.

    Events of a group that come in one batch are put in order; one that comes in a later
    batch is decided after those that were there before it, whatever its time.
    """
    return events.groupBy("group").transformWithStateInPandas(Commands(rules or CommandRules()), _schema(events.sparkSession, OUTCOME), "Append", "None")


def lease_stream(events: DataFrame, rules: LeaseRules | None = None, *, late: str = "0 seconds") -> DataFrame:
    """``commands.leases`` over a stream of the same columns and ``time``, the timestamp of ``at``.

    A lease ends when the watermark passes its end, even if nothing more comes for its
    board; events that come later than ``late`` behind the newest are lost. A lease whose
    end the watermark has not reached is not put out.
    """
    marked = events.withWatermark("time", late)
    return marked.groupBy("board").transformWithStateInPandas(Leases(rules or LeaseRules()), _schema(events.sparkSession, ENDED), "Append", "EventTime")
