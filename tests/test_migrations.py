"""Schema steps: reading through the ledger, migration, drift and shape faults."""

import pytest

from folioflow.sources.migrations import Schema, SchemaFault, Step, VersionedTables

FIRST = {"posts": "id int, title string, views int", "boards": "name string"}
STEPS = [Step("posts", "add", "lang", "string", default="ko"), Step("posts", "rename", "title", to="name"), Step("posts", "widen", "views", "bigint"), Step("boards", "add", "posts", "bigint"), Step("posts", "drop", "lang")]


def stored(spark, root, steps, version=0):
    tables = VersionedTables(Schema(spark, FIRST, steps), root)
    tables.create({"posts": spark.createDataFrame([(1, "a", 5), (2, None, None)], "id int, title string, views int"), "boards": spark.createDataFrame([("b",)], "name string")})
    return tables


def test_old_versions_read_like_migrated_ones(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    stored(spark, root, [])
    for n in range(1, len(STEPS) + 1):
        tables = VersionedTables(Schema(spark, FIRST, STEPS[:n]), root)
        through = {t: (tables.open(t).dtypes, sorted(tables.open(t).collect(), key=str)) for t in FIRST}
        if n % 2:  # a store may be several versions behind
            assert tables.migrate() == max(0, n - 2)
            assert tables.migrate() == n
        assert {t: (tables.open(t).dtypes, sorted(tables.open(t).collect(), key=str)) for t in FIRST} == through
    assert [(f.name, f.dataType.simpleString()) for f in tables.open("posts").schema] == [("id", "int"), ("name", "string"), ("views", "bigint")]


def test_drift_is_a_fault(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    stored(spark, root, [])
    VersionedTables(Schema(spark, FIRST, STEPS[:3]), root).migrate()
    other = [STEPS[0], Step("posts", "rename", "title", to="caption"), STEPS[2]]
    with pytest.raises(SchemaFault, match="version 2 has changed; version 3 has changed"):
        VersionedTables(Schema(spark, FIRST, other), root).open("posts")
    with pytest.raises(SchemaFault, match="version 2 is unknown"):
        VersionedTables(Schema(spark, FIRST, STEPS[:1]), root).open("posts")
    schema = Schema(spark, FIRST, STEPS)
    assert schema.faults(schema.ledger().filter("version <> 2")) == ["version 2 is missing"] and schema.faults(schema.ledger()) == []


def test_steps_that_do_not_fit(spark, tmp_path):
    rows = spark.createDataFrame([], FIRST["posts"])
    for step, told in [(Step("posts", "add", "id", "int"), "already"), (Step("posts", "rename", "x", to="y"), "has no x"), (Step("posts", "rename", "id", to="views"), "already"), (Step("posts", "widen", "title", "int"), "can't be widened"), (Step("posts", "split", "id"), "unknown kind")]:
        with pytest.raises(SchemaFault, match=told):
            step.applied(rows)
    tables = VersionedTables(Schema(spark, FIRST, STEPS), f"file://{tmp_path}/none")
    for act in (tables.migrate, lambda: tables.open("posts")):
        with pytest.raises(SchemaFault, match="no store"):
            act()
    with pytest.raises(SchemaFault, match="isn't in the form"):
        tables.create({"posts": spark.createDataFrame([], "id int"), "boards": spark.createDataFrame([], "name string")})
