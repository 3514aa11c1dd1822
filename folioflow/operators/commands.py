"""A queue of commands with one active command per conflict group, and leases of boards.

Whether a command is accepted depends on what the one before it has become, so events of a
group are decided one after the other. The rules are plain functions of a small state;
here they run over tables, sorted by group and time and read as they come, and
``folioflow.streaming.stateful`` runs the same rules over streams.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.sources.shared import shuffle_partitions

#: Times of a command in microseconds, and how often it may be claimed.
TTL = 15 * 60 * 1_000_000
LEASE = 2 * 60 * 1_000_000
CLAIMS = 2


@dataclass
class Command:
    """The active command of a group; state is none, queued or claimed."""

    state: str = "none"
    command: int | None = None
    runner: str | None = None
    expires: int = 0
    until: int = 0
    claims: int = 0


@dataclass
class CommandRules:
    ttl: int = TTL
    lease: int = LEASE
    most_claims: int = CLAIMS

    def decide(self, now: Command, at: int, kind: str, command: int | None, runner: str | None, known: int | None) -> tuple[Command, str, int | None]:
        """The group's next state, the outcome of an event, and the command that it is about.

        ``known``: the command that was accepted under the event's key before, if any.
        """
        if kind == "create" and known is not None:
            return now, "replayed", known
        if now.state == "queued" and now.expires <= at:
            now = Command()
        if kind == "create":
            if now.state != "none":
                return now, "conflict", now.command
            return Command("queued", command, None, at + self.ttl), "accepted", command
        if kind == "claim":
            if now.state == "claimed" and now.until <= at:  # its runner is gone
                now = Command("queued", now.command, None, now.expires, 0, now.claims) if now.claims < self.most_claims else Command()
            if now.state != "queued" or now.expires <= at:
                return now, "nothing", None
            return Command("claimed", now.command, runner, now.expires, at + self.lease, now.claims + 1), "claimed", now.command
        held = now.state == "claimed" and now.runner == runner
        if kind == "beat":
            return (Command(now.state, now.command, runner, now.expires, at + self.lease, now.claims), "renewed", now.command) if held else (now, "ignored", None)
        if kind == "finish":
            return (Command(), "finished", now.command) if held else (now, "not_finishable", None)
        if kind == "cancel":
            return (Command(), "cancelled", now.command) if now.state == "queued" else (now, "not_cancellable", None)
        return now, "unknown_kind", None


@dataclass
class Lease:
    """Who holds a board, since and until when, and its beats; no holder: free."""

    runner: str | None = None
    since: int = 0
    until: int = 0
    beats: int = 0
    refused: int = 0


@dataclass
class LeaseRules:
    lease: int = LEASE

    def decide(self, now: Lease, at: int, kind: str, runner: str | None) -> tuple[Lease, list[tuple]]:
        """The next state, and leases that have ended: (runner, since, until, beats, refused, how).

        A claim takes a free board, and the holder's claims and beats extend its lease. Others'
        are refused, and so is a beat after the lease has ended: its runner must claim again.
        """
        now, ended = self.expire(now, at)
        if now.runner is None:
            return (Lease(runner, at, at + self.lease, 1) if kind == "claim" and runner is not None else now), ended
        if now.runner != runner:
            return Lease(**asdict(now) | {"refused": now.refused + 1}), ended
        if kind == "release":
            return Lease(), [*ended, (runner, now.since, at, now.beats, now.refused, "released")]
        return Lease(runner, now.since, at + self.lease, now.beats + 1, now.refused), ended

    @staticmethod
    def expire(now: Lease, at: int) -> tuple[Lease, list[tuple]]:
        if now.runner is None or now.until > at:
            return now, []
        return Lease(), [(now.runner, now.since, now.until, now.beats, now.refused, "expired")]


COMMAND_EVENT = ["group", "at", "seq", "kind", "command", "key", "runner"]
LEASE_EVENT = ["board", "at", "seq", "kind", "runner"]


@dataclass
class _Known:
    """Commands accepted under keys that will come again; a key is forgotten at its last event."""

    accepted: dict[str, int] = field(default_factory=dict)


def _sorted_by(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), key).sortWithinPartitions(F.col(key).asc_nulls_first(), "at", "seq")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some, strict=True), kinds, strict=True)], names)


def command_outcomes(events: DataFrame, rules: CommandRules | None = None) -> DataFrame:
    """(group, seq, outcome, command) of every event: group string, at long (microseconds), seq long, kind, command long, key, runner.

    Events of a group are taken in order of at and seq, which doesn't repeat. Kinds are
    create, claim, beat, finish and cancel. A create is replayed if one of its key was
    accepted, is a conflict while a command of its group is queued or claimed, and is
    accepted else; a null key is never known. Null groups are a group. An empty table gives
    no rows. A group passes through one task as it comes; that task holds one command and
    the keys that stand in several creates of the group and have not all come yet.
    """
    rules = rules or CommandRules()
    same = Window.partitionBy("group", "key")
    again = F.when((F.col("kind") == "create") & F.col("key").isNotNull(), F.lead("seq").over(same.orderBy(F.col("kind") != "create", "at", "seq")).isNotNull())
    again = F.coalesce(again & (F.lead("kind").over(same.orderBy(F.col("kind") != "create", "at", "seq")) == "create"), F.lit(False))
    rows = _sorted_by(events.select(*COMMAND_EVENT).withColumn("again", again), "group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decided():
            for group, own in itertools.groupby(_rows(batches), lambda r: r[0]):
                state, known = Command(), _Known()
                for _, at, seq, kind, command, key, runner, more in own:
                    create = kind == "create"
                    before = known.accepted.get(key) if create else None
                    state, outcome, about = rules.decide(state, at, kind, command, runner, before)
                    if create and outcome == "accepted" and more:
                        known.accepted[key] = command
                    elif create and not more:
                        known.accepted.pop(key, None)
                    yield group, seq, outcome, about

        return _batches(decided(), ["group", "seq", "outcome", "command"], [pa.string(), pa.int64(), pa.string(), pa.int64()])

    return rows.mapInArrow(run, "group string, seq long, outcome string, command long")


def leases(events: DataFrame, rules: LeaseRules | None = None, *, until: int | None = None) -> DataFrame:
    """(board, runner, since, until, beats, refused, ended) of all leases of boards: events are board string, at long, seq long, kind, runner.

    Kinds are claim, beat and release; see ``LeaseRules``. A lease that is live after its board's
    last event ends with its time, unless ``until`` (microseconds) is given and comes first:
    then it is left out. Null boards are a board; an empty table gives no rows.
    """
    rules = rules or LeaseRules()
    rows = _sorted_by(events.select(*LEASE_EVENT), "board")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for board, own in itertools.groupby(_rows(batches), lambda r: r[0]):
                state = Lease()
                for _, at, _, kind, runner in own:
                    state, ended = rules.decide(state, at, kind, runner)
                    for e in ended:
                        yield board, *e
                for e in rules.expire(state, 2**62 if until is None else until)[1]:
                    yield board, *e

        kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.string()]
        return _batches(found(), ["board", "runner", "since", "until", "beats", "refused", "ended"], kinds)

    return rows.mapInArrow(run, "board string, runner string, since long, until long, beats long, refused long, ended string")
