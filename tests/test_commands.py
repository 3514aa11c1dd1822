"""Commands and leases: rules, tables and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import commands
from folioflow.operators.commands import Command, CommandRules, Lease, LeaseRules
from folioflow.streaming import stateful

COMMAND = "group string, at long, seq long, kind string, command long, key string, runner string"
LEASE = "board string, at long, seq long, kind string, runner string"


def outcomes(rules, events):
    state, known, out = Command(), {}, []
    for at, kind, command, key, runner in events:
        state, outcome, about = rules.decide(state, at, kind, command, runner, known.get(key) if kind == "create" else None)
        if outcome == "accepted" and key is not None:
            known[key] = command
        out.append((outcome, about))
    return out


def test_command_rules():
    rules = CommandRules(ttl=100, lease=10, most_claims=2)
    got = outcomes(rules, [
        (0, "create", 1, "a", None), (1, "create", 2, "b", None), (2, "create", 1, "a", None), (3, "claim", None, None, "r"), (4, "beat", None, None, "s"),
        (5, "beat", None, None, "r"), (6, "cancel", None, None, None), (14, "claim", None, None, "s"), (15, "claim", None, None, "s"), (16, "finish", None, None, "r"),
        (25, "claim", None, None, "t"), (26, "create", 3, "b", None), (126, "create", 4, None, None), (127, "cancel", None, None, None), (128, "claim", None, None, "t"),
        (130, "create", 5, None, None), (230, "claim", None, None, "t"), (231, "create", 6, None, None), (232, "claim", None, None, "t"), (240, "finish", None, None, "t"), (241, "create", 1, "a", None),
    ])
    assert got == [
        ("accepted", 1), ("conflict", 1), ("replayed", 1), ("claimed", 1), ("ignored", None), ("renewed", 1), ("not_cancellable", None), ("nothing", None), ("claimed", 1),
        ("not_finishable", None), ("nothing", None), ("accepted", 3), ("accepted", 4), ("cancelled", 4), ("nothing", None), ("accepted", 5), ("nothing", None), ("accepted", 6), ("claimed", 6), ("finished", 6), ("replayed", 1),
    ]


def random_commands(n=1500, groups=12):
    rng = np.random.default_rng(2)
    kinds = ["create", "create", "claim", "beat", "finish", "cancel", "odd"]
    return [
        (None if g == 0 else f"g{g}", int(rng.integers(0, 20_000)), k, str(rng.choice(kinds)), k, None if rng.random() < 0.1 else f"k{rng.integers(40)}", f"r{rng.integers(2)}")
        for k, g in enumerate(np.minimum(rng.integers(0, 2 * groups, n), groups).tolist())
    ]  # half of the events are of one group


def expected_commands(rules, rows):
    out = []
    for group in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1], r[2]))
        decided = outcomes(rules, [(at, kind, command, key, runner) for _, at, _, kind, command, key, runner in own])
        out += [(group, r[2], *d) for r, d in zip(own, decided, strict=True)]
    return sorted(out, key=str)


def test_commands_of_tables(spark):
    rules, rows = CommandRules(ttl=300, lease=100), random_commands()
    got = commands.command_outcomes(spark.createDataFrame(rows, COMMAND).repartition(5), rules).collect()
    assert sorted(map(tuple, got), key=str) == expected_commands(rules, rows)
    assert {r.outcome for r in got} >= {"accepted", "replayed", "conflict", "claimed", "renewed", "finished", "cancelled", "unknown_kind"}
    assert commands.command_outcomes(spark.createDataFrame([], COMMAND)).count() == 0


def test_lease_rules():
    rules, state, ended = LeaseRules(10), Lease(), []
    for at, kind, runner in [(0, "beat", "a"), (1, "claim", "a"), (5, "claim", "b"), (9, "beat", "a"), (18, "beat", "b"), (19, "beat", "a"), (20, "claim", "b"), (21, "release", "a"), (22, "release", "b"), (30, "claim", None)]:
        state, more = rules.decide(state, at, kind, runner)
        ended += more
    assert ended == [("a", 1, 19, 2, 2, "expired"), ("b", 20, 22, 1, 1, "released")]
    assert state == Lease()


def random_beats(n=1200, boards=10):
    rng = np.random.default_rng(3)
    rows = [(f"b{min(int(rng.integers(0, 2 * boards)), boards)}", int(t), k, str(rng.choice(["claim", "beat", "beat", "release"], p=[0.3, 0.3, 0.3, 0.1])), f"r{rng.integers(2)}") for k, t in enumerate(sorted(rng.integers(0, 10**9, n)))]
    return rows


def plain_leases(rules, rows):
    out = []
    for board in {r[0] for r in rows}:
        state = Lease()
        for _, at, _, kind, runner in sorted((r for r in rows if r[0] == board), key=lambda r: (r[1], r[2])):
            state, ended = rules.decide(state, at, kind, runner)
            out += [(board, *e) for e in ended]
        out += [(board, *e) for e in rules.expire(state, 2**62)[1]]
    return sorted(out)


def test_leases_of_tables(spark):
    rules, rows = LeaseRules(9_000_000), random_beats()
    assert sorted(map(tuple, commands.leases(spark.createDataFrame(rows, LEASE).repartition(4), rules).collect())) == plain_leases(rules, rows)
    assert commands.leases(spark.createDataFrame([], LEASE)).count() == 0


@pytest.fixture
def state_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, tmp_path, rows, schema, build, files=2):
    """Rows in files, a batch for each; what the stream has put out at the end, by batch."""
    step = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    found = []
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = build(source).writeStream.foreachBatch(lambda batch, n: found.extend((n, *r) for r in batch.collect())).option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return found


def test_commands_of_streams(spark, tmp_path, state_store):
    rules = CommandRules(ttl=300, lease=100)
    rows = sorted(random_commands(400), key=lambda r: (r[1], r[2]))
    got = streamed(spark, tmp_path, rows, COMMAND, lambda s: stateful.command_stream(s, rules))
    assert sorted((tuple(r[1:]) for r in got), key=str) == expected_commands(rules, rows)


def test_leases_of_streams_end_by_timer(spark, tmp_path, state_store):
    rules = LeaseRules(9_000_000)
    rows = random_beats(300)
    rows += [("quiet", 2_000_000_000, 1000, "claim", "r0"), ("end", 5_000_000_000, 1001, "claim", "r1"), ("end", 5_000_000_001, 1002, "claim", "r1")]
    got = streamed(spark, tmp_path, rows, LEASE, lambda s: stateful.lease_stream(s.withColumn("time", F.timestamp_micros("at")), rules))
    last = 5_000_000_001
    assert sorted(tuple(r[1:]) for r in got) == [r for r in plain_leases(rules, rows) if r[0] != "end" and r[3] <= last]
    assert ("quiet", "r0", 2_000_000_000, 2_009_000_000, 1, 0, "expired") in [tuple(r[1:]) for r in got]  # nothing came for it after its claim


def test_late_beats_lose(spark, tmp_path, state_store):
    rules = LeaseRules(1_000_000)
    rows = [("a", 10_000_000, 0, "claim", "r"), ("b", 60_000_000, 1, "claim", "r"), ("b", 70_000_000, 2, "claim", "r"), ("b", 90_000_000, 3, "claim", "r"), ("a", 10_500_000, 4, "beat", "r"), ("b", 95_000_000, 5, "beat", "r")]
    got = streamed(spark, tmp_path, rows, LEASE, lambda s: stateful.lease_stream(s.withColumn("time", F.timestamp_micros("at")), rules), files=3)
    assert [tuple(r[1:]) for r in got if r[1] == "a"] == [("a", "r", 10_000_000, 11_000_000, 1, 0, "expired")]
