import pytest
from pyspark.sql import functions as F

from tidemark.operators import ancestry, logset, merge
from tidemark.schema import ENTRIES, LOG


def entries(spark, peer, *rows):
    full = [{"uuid": "1", "path": "a.md", "kind": "file", "hash": "h", "size": 1, "created": 1000, "updated": 1000, "peer": peer, "deleted": False} | r for r in rows]
    names = [x.strip().split(" ")[0] for x in ENTRIES.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], ENTRIES)


def log(spark, *rows):
    full = [{"uuid": "1", "path": "a.md", "kind": "file", "type": "write", "at_ms": 1000, "peer": "device-a", "op": f"op{i}"} | r for i, r in enumerate(rows)]
    names = [x.strip().split(" ")[0] for x in LOG.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], LOG)


def run(spark, a, b, rows=(), copies="edits", known_b=()):
    ea, eb, history = entries(spark, "device-a", *a), entries(spark, "device-b", *b), log(spark, *rows)
    edges = ancestry.version_edges(merge.entry_rows(ea), merge.entry_rows(eb), history)
    moves = ancestry.location_edges(ea, eb, history)
    heard = spark.createDataFrame([(u,) for u in known_b], "uuid string")
    out, conflicts = merge.merge_entries(ea, eb, edges, moves, logset.latest(history), ea.select("uuid"), eb.select("uuid").union(heard), merge.MergeOptions(copies=copies))
    return {r["uuid"]: r for r in out.collect()}, conflicts.collect()


def test_pair_by_path(spark):
    out, _ = run(spark, [{"uuid": "zzz"}], [{"uuid": "aaa"}])
    assert list(out) == ["aaa"]
    out, _ = run(spark, [{"uuid": "zzz"}], [{"uuid": "aaa"}], known_b=["zzz"])
    assert sorted(out) == ["aaa", "zzz"]


def test_propagates_and_finds_far_parents(spark):
    out, conflicts = run(spark, [{"hash": "new", "updated": 2000, "prev": "mid"}], [{"hash": "old"}], [{"hash": "mid", "prev": "old"}])
    assert out["1"]["hash"] == "new" and not conflicts


def test_content_conflict_keeps_a_copy(spark):
    out, conflicts = run(spark, [{"hash": "x", "prev": "old"}], [{"hash": "y", "updated": 2000, "prev": "old"}])
    assert out["1"]["hash"] == "y" and conflicts[0]["winner"] == "b" and conflicts[0]["kind"] == "content"
    copy = out["conflict:1:x"]
    assert copy["path"] == "a (conflict device-a x).md" and copy["conflict_of"] == "1" and copy["base"] == "old"


def test_rename_and_edit_both_apply(spark):
    out, conflicts = run(spark, [{"path": "other.md", "hash": "old", "prev_path": "a.md", "updated": 2000}], [{"hash": "edited", "updated": 3000, "prev": "old"}])
    assert (out["1"]["path"], out["1"]["hash"]) == ("other.md", "edited") and not conflicts


def test_rename_chain(spark):
    out, conflicts = run(spark, [{"path": "c.md", "prev_path": "b.md", "updated": 2000}], [{}], [{"path": "b.md", "prev_path": "a.md", "type": "rename", "hash": "h"}])
    assert out["1"]["path"] == "c.md" and not conflicts


def test_two_renames(spark):
    out, conflicts = run(spark, [{"path": "left.md"}], [{"path": "right.md", "updated": 2000}])
    assert out["1"]["path"] == "right.md" and [c["kind"] for c in conflicts] == ["location"] and len(out) == 1


@pytest.mark.parametrize("swap", [False, True])
def test_ties_do_not_depend_on_the_side(spark, swap):
    x, y = [{"hash": "aaa", "updated": 5000, "peer": "p"}], [{"hash": "bbb", "updated": 5000, "peer": "q"}]
    out, _ = run(spark, *((y, x) if swap else (x, y)))
    assert out["1"]["hash"] == "bbb"


def test_delete_against_edit(spark):
    gone, edit = [{"hash": None, "size": 0, "deleted": True, "updated": 3000, "prev": "old"}], [{"hash": "edited", "updated": 2000, "prev": "old"}]
    out, conflicts = run(spark, gone, edit)
    assert out["1"]["deleted"] and conflicts[0]["kind"] == "delete-edit" and len(out) == 1
    out, _ = run(spark, gone, edit, copies="always")
    assert out["conflict:1:edited"]["reason"] == "delete-edit"


def test_resurrection_guard(spark):
    out, _ = run(spark, [{"updated": 50}], [{"uuid": "2", "path": "b.md"}], [{"type": "delete", "at_ms": 100}])
    assert out["1"]["deleted"] and out["1"]["updated"] == 100 and not out["2"]["deleted"]


def test_directory_loses_its_path(spark):
    out, _ = run(spark, [{"uuid": "d", "kind": "directory", "path": "shelf", "hash": None}, {"uuid": "c", "path": "shelf/x.png"}], [{"uuid": "f", "path": "shelf", "updated": 5000}])
    assert out["f"]["path"] == "shelf" and out["d"]["path"].startswith("shelf (conflict device-a ") and out["d"]["reason"] == "kind"
    assert out["c"]["path"] == out["d"]["path"] + "/x.png" and out["c"]["prev_path"] == "shelf/x.png"


def test_a_losing_file_leaves_directories_alone(spark):
    out, _ = run(spark, [{"uuid": "f", "path": "shelf"}], [{"uuid": "d", "kind": "directory", "path": "shelf", "hash": None, "updated": 5000}, {"uuid": "c", "path": "shelf/x.png"}])
    assert out["c"]["path"] == "shelf/x.png" and out["f"]["path"].startswith("shelf (conflict ")


def test_nested_directories_lose_their_paths(spark):
    old = [{"uuid": "d", "kind": "directory", "path": "p", "hash": None}, {"uuid": "e", "kind": "directory", "path": "p/q", "hash": None}, {"uuid": "x", "path": "p/q/x"}]
    out, conflicts = run(spark, old, [{"uuid": "f", "path": "p", "updated": 5000}, {"uuid": "g", "path": "p/q", "updated": 5000}])
    p = "p (conflict device-a d)"
    assert {u: r["path"] for u, r in out.items()} == {"d": p, "e": f"{p}/q (conflict device-a e)", "f": "p", "g": f"{p}/q", "x": f"{p}/q/x"}
    assert {(c["uuid"], c["kind"], c["path"], c["copy"]) for c in conflicts} == {("d", "kind", "p", "d"), ("e", "kind", "p/q", "e")}


def test_two_files_on_one_path(spark):
    out, conflicts = run(spark, [{"uuid": "1", "hash": "x"}], [{"uuid": "2", "hash": "y", "updated": 5000}], known_b=["1"])
    assert out["2"]["path"] == "a.md" and out["1"]["path"] == "a (conflict device-a x).md" and out["1"]["reason"] == "binary"
    assert [(c["uuid"], c["kind"], c["copy"]) for c in conflicts] == [("1", "content", "1")]


def test_common_ancestor_looks_at_prev_first(spark):
    edges = spark.createDataFrame([("1", "m", "z", 0), ("1", "m", "a", 1), ("1", "n", "a", 0), ("1", "n", "z", 1), *(("1", f"c{i}", f"c{i + 1}", 0) for i in range(70))], "uuid string, hash string, parent string, branch int")
    pairs = spark.createDataFrame([("1", "m", "n"), ("1", "n", "m"), ("1", "c0", "c60")], "uuid string, left string, right string")
    assert {r["left"]: r["base"] for r in ancestry.common_ancestor(pairs, edges).collect()} == {"m": "z", "n": "a", "c0": "c61"}


def test_merging_again_changes_nothing(spark):
    a = [{"hash": "x"}]
    out, conflicts = run(spark, a, a)
    assert len(out) == 1 and not conflicts


def test_ancestry(spark):
    edges = spark.createDataFrame([("1", "new", "mid", 0), ("1", "mid", "old", 0), ("1", "x", "y", 0), ("1", "y", "x", 0), ("1", "left", "mid", 0)], "uuid string, hash string, parent string, branch int")
    pairs = spark.createDataFrame([("1", "new", "old"), ("1", "old", "new"), ("1", "new", None), ("1", "x", "x")], "uuid string, hash string, ancestor string").withColumns({"prev": F.lit(None).cast("string"), "prev2": F.lit(None).cast("string")})
    assert {(r["hash"], r["ancestor"]): r["descends"] for r in ancestry.descends(pairs, edges).collect()} == {("new", "old"): True, ("old", "new"): False, ("new", None): False, ("x", "x"): True}
    two = spark.createDataFrame([("1", "new", "left"), ("1", "new", "x")], "uuid string, left string, right string")
    assert {r["right"]: r["base"] for r in ancestry.common_ancestor(two, edges).collect()} == {"left": "mid", "x": None}
