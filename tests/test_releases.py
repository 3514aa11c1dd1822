"""Releases, their pointer and its recovery after every step."""

import pytest

from folioflow.sources.releases import ReleaseError, Releases


class Stops(Releases):
    """Dies before or within the n-th file it writes."""

    left = 10**9
    torn = False

    def _write(self, name, value, *, over=False):
        if self.left == 0:
            if self.torn and not over:
                out = self._fs.create(self._path(name), False)
                out.write(bytearray(b'{"st'))
                out.close()
            raise KeyboardInterrupt(name)
        self.left -= 1
        super()._write(name, value, over=over)


def tables(spark, n):
    return {"posts": spark.range(n).withColumnRenamed("id", "post"), "boards": spark.range(2)}


def test_activate_and_go_back(spark, tmp_path):
    store = Releases(spark, f"file://{tmp_path}/r")
    assert store.active() is None and store.recover() is None
    for k in (1, 2, 3):
        store.stage(f"r{k}", tables(spark, k))
        store.activate(f"r{k}")
        assert (store.active(), store.table("posts").count()) == (f"r{k}", k)
    assert [store.rollback(), store.rollback()] == ["r2", "r1"]
    with pytest.raises(ReleaseError, match="no release to go back to"):
        store.rollback()
    store.activate("r3")
    assert store.rollback() == "r1" and store.active() == "r1"
    with pytest.raises(ReleaseError, match="already"):
        store.stage("r1", tables(spark, 1))
    with pytest.raises(ReleaseError, match="not complete"):
        store.activate("r9")


@pytest.mark.parametrize("torn", [False, True])
def test_recovery_after_every_step(spark, tmp_path, torn):
    outcomes = []
    for step in range(4):
        root = f"file://{tmp_path}/{step}"
        store = Stops(spark, root)
        store.stage("old", tables(spark, 1))
        store.stage("new", tables(spark, 2))
        store.activate("old")
        store.left, store.torn = step, torn
        if step < 3:
            with pytest.raises(KeyboardInterrupt):
                store.activate("new")
        else:
            store.activate("new")
        again = Releases(spark, root)
        seen = again.active()
        assert again.recover() == {0: None, 1: "dropped", 2: "done", 3: None}[step]
        assert again.active() == seen and again.recover() is None
        outcomes.append(seen)
        again.activate("new")
        assert again.active() == "new" and again.table("posts").count() == 2
    assert outcomes == ["old", "old", "new", "new"]


def test_first_activation_lost_pointer_and_changed_tables(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    store = Stops(spark, root)
    store.stage("a", tables(spark, 1))
    store.left = 1
    with pytest.raises(KeyboardInterrupt):
        store.activate("a")
    store.left = 10
    assert store.recover() == "dropped" and store.active() is None
    store.activate("a")
    store.stage("b", tables(spark, 3))
    store.left = 1
    with pytest.raises(KeyboardInterrupt):
        store.activate("b")
    store.left = 10
    (tmp_path / "r" / "current.json").unlink()
    assert store.recover() == "done" and store.active() == "b"
    spark.range(9).withColumnRenamed("id", "post").write.mode("overwrite").parquet(f"{root}/releases/a/posts")
    with pytest.raises(ReleaseError, match="has changed"):
        store.rollback()
    assert store.active() == "b"


def test_two_writers(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    store, other = Releases(spark, root), Stops(spark, root)
    store.stage("a", tables(spark, 1))
    number = len(store.entries())
    store._append(number, step="intent", release="a", before=None)
    with pytest.raises(ReleaseError, match="another writer"):
        other._append(number, step="intent", release="a", before=None)
