"""Trees of digests: what differs is found, and only its leaves are read."""

import random

from pyspark.sql import functions as F

from tidemark.operators.merkle import changed_tree, differing_leaves, open_state, state_difference, store_state
from tidemark.schema import ENTRIES

NAMES = [x.strip().split(" ")[0] for x in ENTRIES.split(",")]


def state(spark, rows):
    full = [{"uuid": u, "path": p, "hash": h, "kind": "file", "size": 1, "created": 1, "updated": 2, "peer": "a", "deleted": d} for u, p, h, d in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in full], ENTRIES)


def test_difference(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"u{i}", f"p{i}", f"h{rng.randrange(9)}", i % 7 == 0) for i in range(600)]
    other = [r for r in rows if r[0] != "u8"]
    other[5] = ("u5", "elsewhere", rows[5][2], False)
    other += [("new", "n", "h", False), ("gone", "g", None, True)]
    a, b = store_state(state(spark, rows), str(tmp_path / "a")), store_state(state(spark, other), str(tmp_path / "b"))
    assert sorted(tuple(r) for r in state_difference(a, b).collect()) == [("new", "only_b", None, "n"), ("u5", "differs", "p5", "elsewhere"), ("u8", "only_a", "p8", None)]
    assert state_difference(a, open_state(spark, str(tmp_path / "a"))).collect() == []
    none = store_state(state(spark, []), str(tmp_path / "n"), 1)
    some = store_state(state(spark, [("u", "p", "h", False)]), str(tmp_path / "s"), 1)
    assert [r["state"] for r in state_difference(none, some).collect()] == ["only_b"] and state_difference(none, none).collect() == []


def test_one_change_reads_one_leaf(spark, tmp_path):
    rows = [(f"u{i}", f"p{i}", "h", False) for i in range(2000)]
    a = store_state(state(spark, rows), str(tmp_path / "a"))
    b = store_state(state(spark, [("u77", "p77", "other", False) if r[0] == "u77" else r for r in rows]), str(tmp_path / "b"))
    found = differing_leaves(a.tree, b.tree, 2)
    assert found.count() == 1
    name = found.first()["leaf"]
    read = a.entries.filter(F.col("leaf").isin([name]))
    assert read.count() < 40  # of 2000, in 256 leaves
    plan = state_difference(a, b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(leaf") == 2 and name in plan
    assert [tuple(r)[:2] for r in state_difference(a, b).collect()] == [("u77", "differs")]


def test_tree_after_a_change_is_that_of_the_new_state(spark, tmp_path):
    rows = [(f"u{i}", f"p{i}", "h", False) for i in range(50)]
    a = store_state(state(spark, rows), str(tmp_path / "a"), 1)
    before = state(spark, rows[:2])
    after = state(spark, [("u0", "p0", "h2", False), ("u1", "p1", None, True), ("more", "m", "h", False)])
    b = store_state(state(spark, [("u0", "p0", "h2", False), *rows[2:], ("more", "m", "h", False)]), str(tmp_path / "b"), 1)
    pick = lambda t: sorted(tuple(r) for r in t.select("level", "node", "n", "digest").collect())
    assert pick(changed_tree(a.tree, before, after, 1)) == pick(b.tree)
