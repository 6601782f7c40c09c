"""Commits, text merging and marks, from folders to converged peers."""

import hashlib
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.merge import MergeOptions, entry_rows
from tidemark.plans.commit import commit
from tidemark.plans.mesh import chain, classes, converge, full, star
from tidemark.plans.scratch import shared_dir
from tidemark.plans.sync import PeerState, SyncOptions, arriving, plan_sync, sync
from tidemark.schema import ENTRIES, LOG

FILES = "path string, kind string, size long, mtime long, native string, content binary"


def folder(spark, **texts):
    return spark.createDataFrame([(p.replace("_", "."), "file", len(t), zlib.crc32(t.encode()), None, bytearray(t.encode())) for p, t in texts.items()], FILES)


def empty(spark, name):
    return PeerState(name, spark.createDataFrame([], ENTRIES).drop("store"), spark.createDataFrame([], LOG).drop("store", "segment"))


def paths(state):
    return {r["path"]: r["hash"] for r in state.entries.filter("not deleted").collect()}


def state(spark, name, **texts):
    """A peer that has files and their texts, without a commit."""
    names = [x.strip().split(" ")[0] for x in ENTRIES.split(",")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [{"uuid": f"{name}-{p}", "path": p.replace("_", "."), "kind": "file", "hash": sha(t), "size": len(t), "created": 1, "updated": 1000 + ord(name), "peer": name, "deleted": False} for p, t in texts.items()]
    contents = spark.createDataFrame([(sha(t), t) for t in texts.values()], "hash string, text string")
    return PeerState(name, entry_rows(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ENTRIES)), spark.createDataFrame([], LOG).drop("store", "segment"), contents=contents)


def both(spark, x="one\ntwo\nthree\n"):
    """Two peers that share a note."""
    a, _ = commit(empty(spark, "a"), folder(spark, n_md=x), 1000, "b1")
    b = empty(spark, "b")
    a, b, changed = sync(a, b, at_ms=1100)
    assert changed and paths(a) == paths(b)
    # the other side has the text on its disk, too
    b.bases = a.bases
    return a, b


def test_commit(spark):
    a, batch = commit(empty(spark, "a"), folder(spark, n_md="x", m_bin="y"), 1000, "b1")
    assert batch == "b1" and set(paths(a)) == {"n.md", "m.bin"} and a.log.count() == 2
    assert [r["text"] for r in a.bases.collect()] == ["x"]  # of texts alone
    again, batch = commit(a, folder(spark, n_md="x", m_bin="y"), 2000, "b2")
    assert batch is None and again is a
    c, batch = commit(a, folder(spark, n_md="xx"), 500, "b3")
    rows = {(r["type"], r["path"], r["at_ms"], r["seq"]) for r in c.log.filter("batch = 'b3'").collect()}
    assert batch == "b3" and rows == {("write", "n.md", 1001, 2), ("delete", "m.bin", 1001, 2)}  # after the latest entry, whatever the clock says
    assert sorted(r["text"] for r in c.bases.collect()) == ["x", "xx"]
    d, _ = commit(c, folder(spark, n_md="xxx"), 3000, "b4", rotate_at=10)
    assert d.segment == 3000 and d.snapshot.filter("deleted").count() == 1
    e, _ = commit(d, folder(spark, n_md="xxxx"), 4000, "b5")
    assert {r["segment"] for r in e.log.filter("batch = 'b5'").collect()} == {3000}


def test_texts_merge(spark):
    a, b = both(spark)
    a, _ = commit(a, folder(spark, n_md="ONE\ntwo\nthree\n"), 2000, "b2")
    b, _ = commit(b, folder(spark, n_md="one\ntwo\nTHREE\n"), 2500, "b3")
    a, b, _ = sync(a, b, at_ms=3000)
    assert len(paths(a)) == 1 and paths(a) == paths(b)
    e = a.entries.first()
    assert a.contents.filter(F.col("hash") == e["hash"]).first()["text"] == "ONE\ntwo\nTHREE\n" and e["prev"] and e["prev2"] and e["updated"] == 3001
    assert a.log.filter("prev2 is not null").count() == b.log.filter("prev2 is not null").count() == 1
    assert sync(a, b, at_ms=4000)[2] is False
    marks = {r["peer"]: r for r in a.marks.collect()}
    assert marks["b"]["last_sync"] == 3000 and marks["b"]["seq"] == b.log.agg(F.max("seq")).first()[0]


@pytest.mark.parametrize("hook", [False, True])
def test_texts_that_do_not_merge(spark, hook):
    a, b = both(spark)
    a, _ = commit(a, folder(spark, n_md="LEFT\n"), 2000, "b2")
    b, _ = commit(b, folder(spark, n_md="RIGHT\n"), 2500, "b3")

    @F.pandas_udf("string")
    def longer(path: pd.Series, base: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return x + y

    plan = plan_sync(a, b, SyncOptions(resolve_text=longer) if hook else None, at_ms=3000)
    assert plan.summary().first()["merged"] == int(hook) and plan.conflicts.first()["is_text"]
    a, b, _ = sync(a, b, SyncOptions(resolve_text=longer) if hook else None, at_ms=3000)
    assert len(paths(a)) == (1 if hook else 2) and paths(a) == paths(b)
    if hook:
        assert a.contents.filter(F.col("hash") == paths(a)["n.md"]).first()["text"] == "LEFT\nRIGHT\n"


def test_closed_segments_prove_descent(spark):
    a, b = both(spark)
    for i in range(3):
        a, _ = commit(a, folder(spark, n_md=f"v{i}\n"), 2000 + i, f"b{i}", rotate_at=10)
    assert a.segment > 2000
    plan = plan_sync(a, b)
    assert plan.conflicts.count() == 0 and plan.entries.filter("not deleted").count() == 1
    assert plan_sync(a, b, SyncOptions(archives=False, auto_merge=False)).conflicts.count() == 1


def test_texts_and_ids_of_stores_converge(spark):
    a, b = both(spark)
    a.text, a.store_id, b.text, b.store_id = ("md",), "s2", ("txt",), "s1"
    a, b, changed = sync(a, b, at_ms=9)
    assert changed and a.text == b.text == ("md", "txt") and a.store_id == b.store_id == "s1"
    assert sync(a, b)[2] is False


def tables(spark):
    """All folders under the session's folder for tables."""
    import os

    root = shared_dir(spark).removeprefix("file://")
    return {os.path.join(d, x) for d, names, _ in os.walk(root) for x in names}


def test_quiet_sync_writes_no_table(spark):
    a, b = both(spark)
    before = tables(spark)
    c, d, changed = sync(a, b, at_ms=7000)
    assert not changed and tables(spark) == before
    assert c.entries is a.entries and d.log is b.log
    assert [tuple(r) for r in c.marks.select("peer", "last_sync").collect()] == [("b", 7000)]
    b.text = ("md", "zzz")
    c, d, changed = sync(a, b, at_ms=8000)
    assert changed and "zzz" in c.text and c.text == d.text and tables(spark) == before


def test_only_what_is_written_moves(spark):
    a, b = state(spark, "a", x_bin="one", y_bin="two", z_bin="three"), state(spark, "b", w_bin="two")
    plan = plan_sync(a, b)
    moved = {p: sorted(r["text"] for r in arriving(plan, acts, s, o).collect()) for p, acts, s, o in (("a", plan.actions_a, a, b), ("b", plan.actions_b, b, a))}
    assert moved == {"a": [], "b": ["one", "three"]}  # 'two' is there under another name


def test_held_bytes_stay(spark):
    """A copy that is held on its peer is known to the other, but its bytes are not moved."""
    a, b = state(spark, "a", n_bin="left"), state(spark, "b", n_bin="right")
    a, b, _ = sync(a, b, SyncOptions(merge=MergeOptions(held_at=1), auto_merge=False))
    held = a.entries.filter("held is not null").first()
    assert held["held"] == "a" and paths(a) == paths(b)
    assert held["hash"] in {r["hash"] for r in a.contents.collect()} and held["hash"] not in {r["hash"] for r in b.contents.collect()}
    assert paths(b)["n.bin"] in {r["hash"] for r in a.contents.collect()}


def test_tables_of_the_way_go(spark):
    a, b = state(spark, "a", n_md="ONE", m_md="x"), state(spark, "b", o_md="y")
    before = tables(spark)
    c, d, _ = sync(a, b)
    new = {t.split("/")[-1].rsplit("-", 1)[0] for t in tables(spark) - before if t.rsplit("/", 1)[0] == shared_dir(spark).removeprefix("file://")}
    assert new == {"state-a", "state-b", "contents"}
    c.release()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(c.tables.root + "/log").count()
    assert len(paths(d)) == 3


def test_classes_of_edges():
    assert classes(chain(list("abcd"))) == [[("a", "b")], [("b", "c")], [("c", "d")]]
    assert classes(star(list("abc"))) == [[("a", "b")], [("a", "c")]]
    every = full(list("abcdef"))
    groups = classes(every)
    assert sorted(e for g in groups for e in g) == sorted(every) and len(groups) < len(every)
    assert all(len({p for e in g for p in e}) == 2 * len(g) for g in groups)
    at = {e: i for i, g in enumerate(groups) for e in g}
    assert all(at[x] < at[y] for i, x in enumerate(every) for y in every[i + 1 :] if set(x) & set(y))
    assert classes([("a", "b"), ("c", "d"), ("a", "b")]) == [[("a", "b"), ("c", "d")], [("a", "b")]]


def test_edges_at_once_are_as_one_by_one(spark):
    peers = {n: state(spark, n, same_bin=f"text {n}") for n in "abcd"}
    edges, plain = [("a", "b"), ("c", "d")], SyncOptions(auto_merge=False)
    one = {x: s for e in edges for x, s in zip(e, sync(peers[e[0]], peers[e[1]], plain)[:2], strict=True)}
    two, rounds, conflicts = converge(peers, edges, most=1, options=plain)
    assert rounds == [2] and {n: p.digest() for n, p in one.items()} == {n: p.digest() for n, p in two.items()}
    assert sorted((r["a"], r["b"], r["kind"]) for r in conflicts.collect()) == [("a", "b", "content"), ("c", "d", "content")] and paths(peers["a"])
