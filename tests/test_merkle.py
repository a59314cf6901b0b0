import random

import pytest

from tomeforge.operators.merkle import IncrementalStore, TreeShape, build_tree, changed_leaves, changes, snapshot
from tomeforge.operators.versions import Superseded

SHAPE = TreeShape(8, 4)


def table(spark, rows):
    return snapshot(spark.createDataFrame(rows, "k string, d string, digest int"), "k", "d")


def test_changes_against_brute_force(spark):
    r = random.Random(1)
    old = {f"path/{i}": f"d{r.randrange(9)}" for i in range(400)}
    new = {k: (v if r.random() < 0.95 else "new") for k, v in old.items() if r.random() < 0.97} | {f"more/{i}": None for i in range(5)}
    a, b = table(spark, [(k, v, 0) for k, v in new.items()] + [(None, "x", 0), ("more/1", None, 1)]), table(spark, [(k, v, 0) for k, v in old.items()])
    leaves = changed_leaves(build_tree(a, SHAPE), build_tree(b, SHAPE), SHAPE)
    got = {(x.key, x.change) for x in changes(a, b, leaves, SHAPE).collect()}
    want = {(k, "new") for k in new.keys() - old.keys()} | {(k, "removed") for k in old.keys() - new.keys()} | {(k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    assert got == want and leaves.count() < 256
    assert changed_leaves(build_tree(b, SHAPE), build_tree(b, SHAPE), SHAPE).count() == 0
    empty = table(spark, [])
    assert changes(b, empty, changed_leaves(build_tree(b, SHAPE), build_tree(empty, SHAPE), SHAPE), SHAPE).count() == len(old)
    with pytest.raises(ValueError):
        TreeShape(7, 4)


def test_store_survives_failures(spark, tmp_path):
    store = IncrementalStore(spark, f"file://{tmp_path}/store")
    first = table(spark, [("a", "1", 0), ("b", "1", 0)])
    assert sorted(r.key for r in store.run(first, lambda p: p.select("key")).collect()) == ["a", "b"]
    second = table(spark, [("a", "2", 0), ("b", "1", 0), ("c", "1", 0)])

    def die(pending):
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        store.run(second, die)
    assert store.current()["version"] == 1
    assert sorted(r.key for r in store.run(second, lambda p: p.select("key")).collect()) == ["a", "c"]
    assert store.run(second, lambda p: p.select("key")).count() == 0 and store.current()["version"] == 3
    assert store.vacuum(keep=1, older_than_seconds=-1) == 3 and store.pending(second).count() == 0


def test_record_that_arrives_during_a_run_waits_for_the_next(spark, tmp_path):
    store, folder = IncrementalStore(spark, f"file://{tmp_path}/store"), f"{tmp_path}/in"
    spark.createDataFrame([("a", "1")], "key string, digest string").write.parquet(folder)
    rows = lambda: spark.read.schema("key string, digest string").parquet(folder)

    def slow(pending):
        spark.createDataFrame([("late", "1")], "key string, digest string").write.mode("append").parquet(folder)
        return pending.select("key")

    assert [r.key for r in store.run(rows(), slow).collect()] == ["a"]
    assert [r.key for r in store.run(rows(), lambda p: p.select("key")).collect()] == ["late"]


def test_two_runs_from_one_version(spark, tmp_path):
    store = IncrementalStore(spark, f"file://{tmp_path}/store")
    one, two = table(spark, [("a", "1", 0)]), table(spark, [("b", "1", 0)])

    def overtaken(pending):
        IncrementalStore(spark, store.path).run(two, lambda p: p.select("key"))
        return pending.select("key")

    with pytest.raises(Superseded):
        store.run(one, overtaken)
    assert [r.key for r in store.output().collect()] == ["b"]


def test_growing_snapshot_changes_its_tree(spark, tmp_path):
    store = IncrementalStore(spark, f"file://{tmp_path}/store")
    assert store.run(table(spark, []), lambda p: p.select("key")).count() == 0
    small, large = [(f"k{i}", "1", 0) for i in range(50)], [(f"k{i}", "1", 0) for i in range(5000)] + [("k7777", None, 0)]
    assert store.run(table(spark, small), lambda p: p.select("key")).count() == 50
    assert store.run(table(spark, large), lambda p: p.select("key")).count() == 4951
    before = store.current()["leaf_bits"]
    changed = [(k, "2" if k in ("k3", "k7777") else d, n) for k, d, n in large if k != "k9"]
    got = {(r.key, r.change) for r in store.pending(table(spark, changed)).collect()}
    assert got == {("k3", "changed"), ("k7777", "changed"), ("k9", "removed")} and before > 4
