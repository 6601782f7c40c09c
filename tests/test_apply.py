"""Plans carried out on stores: whole, once, and by tasks that may run twice."""

import hashlib
import os
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.operators.actions import plan_actions
from tidemark.operators.merge import entry_rows
from tidemark.plans.apply import WrongContent, apply_plan, each, move, place, stage_writes, staged_name
from tidemark.schema import ENTRIES
from tidemark.sources.adapter import FolderAdapter, register_folders, write_files

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SF = "/root/testdata/sf0.01"
NAMES = [x.strip().split(" ")[0] for x in ENTRIES.split(",")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def state(spark, *rows):
    full = [{"uuid": u, "path": p, "kind": "directory" if t is None else "file", "hash": t and sha(t), "size": len(t or ""), "created": 1, "updated": 2, "peer": "a", "deleted": False, "held": held} for u, p, t, held in rows]
    return entry_rows(spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in full], ENTRIES))


def folder(tmp_path, **files):
    adapter = FolderAdapter(str(tmp_path))
    for p, t in files.items():
        with adapter.create(p.replace("__", "/").replace("_", ".")) as f:
            f.write(t.encode())
    return adapter


def found(adapter, path=""):
    out = {}
    for e in adapter.list(path):
        if e.path == ".vfs":
            continue
        out |= {e.path: b"".join(adapter.read(e.path)).decode()} if e.kind == "file" else {e.path + "/": None} | found(adapter, e.path)
    return out


def texts(spark, *given):
    return spark.createDataFrame([(sha(t), bytearray(t.encode())) for t in given], "hash string, content binary")


def test_apply(spark, tmp_path):
    adapter = folder(tmp_path, a_md="A", b_md="B", old__c_md="C", gone_md="G", same_md="S")
    now = state(spark, ("1", "a.md", "A", None), ("2", "b.md", "B", None), ("d", "old", None, None), ("3", "old/c.md", "C", None), ("4", "gone.md", "G", None), ("5", "same.md", "S", None))
    # a swap, a folder that moves with its file, a change, a copy of what is there, a new file, an empty folder, and one that is held elsewhere
    then = state(spark, ("1", "b.md", "A", None), ("2", "a.md", "B", None), ("d", "new", None, None), ("3", "new/c.md", "C2", None), ("5", "same.md", "S", None), ("6", "copy.md", "G", None), ("7", "x/y.md", "far", None), ("8", "empty", None, None), ("9", "held.md", "H", "b"))
    acts = plan_actions(now, then, "a")
    done = apply_plan(adapter, then, acts, now, texts(spark, "C2", "far", "unasked"))
    wanted = {"b.md": "A", "a.md": "B", "new/": None, "new/c.md": "C2", "same.md": "S", "copy.md": "G", "x/": None, "x/y.md": "far", "empty/": None}
    assert found(adapter) == wanted and adapter.list(".vfs/stage") == [] and done == {"delete": 1, "rename": 3, "mkdir": 2, "write": 3}
    assert apply_plan(adapter, then, plan_actions(then, then, "a"), then, texts(spark)) == {"delete": 0, "rename": 0, "mkdir": 0, "write": 0} and found(adapter) == wanted


@pytest.mark.parametrize("contents", [[], ["wrong"]])
def test_nothing_changes_where_bytes_are_wrong_or_missing(spark, tmp_path, contents):
    adapter = folder(tmp_path, a_md="A", b_md="B")
    now, then = state(spark, ("1", "a.md", "A", None), ("2", "b.md", "B", None)), state(spark, ("1", "c.md", "new", None))
    given = texts(spark, *contents).withColumn("hash", F.lit(sha("new")))
    with pytest.raises(Exception, match="would arrive as|no content for"):
        apply_plan(adapter, then, plan_actions(now, then, "a"), now, given)
    assert found(adapter) == {"a.md": "A", "b.md": "B"} and adapter.list(".vfs/stage") == []


def test_steps_that_run_twice(spark, tmp_path):
    adapter = folder(tmp_path, a_md="A")
    wanted = spark.createDataFrame([("p/q.md", sha("one two")), ("r.md", sha("A"))], "path string, hash string")
    parts = spark.createDataFrame([(sha("one two"), i, bytearray(t)) for i, t in enumerate((b"one ", b"two"))], "hash string, start long, content binary")
    now = state(spark, ("1", "a.md", "A", None))
    one, two = (stage_writes(adapter, ".vfs/stage/t", wanted, now, parts) for _ in range(2))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and len(adapter.list(".vfs/stage/t")) == 2
    for _ in range(2):
        assert each(two.select("staged", "path"), lambda a, b: place(adapter, a, b)) == 2
        move(adapter, "a.md", "m.md")
    assert found(adapter) == {"p/": None, "p/q.md": "one two", "r.md": "A", "m.md": "A"}
    with pytest.raises(FileNotFoundError):
        place(adapter, ".vfs/stage/t/none", "nowhere.md")
    assert issubclass(WrongContent, ValueError)


class Noted(FolderAdapter):
    """A folder that notes what is read of it."""

    def read(self, path, start=0, end=None):
        with open(f"{self.root}.read", "a") as f:
            f.write(path + "\n")
        return super().read(path, start, end)


@pytest.mark.parametrize("whole", [True, False])
def test_a_content_moves_for_one_path(spark, tmp_path, whole):
    """Other paths copy it from where it is staged; rows of equal contents are one."""
    adapter, stage = Noted(str(tmp_path / "s")), ".vfs/stage/t"
    wanted = spark.createDataFrame([("b", sha("far off")), ("a", sha("far off")), ("c/d", sha("far off")), ("e", sha("one"))], "path string, hash string")
    rows = [("far off", 0, "far off"), ("one", 0, "one"), ("un", 0, "un")] if whole else [("far off", 4, "off"), ("one", 0, "one"), ("far off", 0, "far "), ("un", 0, "un")]
    contents = spark.createDataFrame([(sha(t), i, bytearray(c.encode())) for t, i, c in rows * 3], "hash string, start long, content binary").repartition(3)
    staged = stage_writes(adapter, stage, wanted, state(spark), contents.drop("start") if whole else contents)
    assert sorted(map(tuple, staged.collect())) == [(p, staged_name(stage, p), sha(t), len(t)) for p, t in (("a", "far off"), ("b", "far off"), ("c/d", "far off"), ("e", "one"))]
    assert {r["path"]: b"".join(FolderAdapter.read(adapter, r["staged"])) for r in staged.collect()} == {"a": b"far off", "b": b"far off", "c/d": b"far off", "e": b"one"}
    assert (tmp_path / "s.read").read_text().split() == [staged_name(stage, "a")] * 2


def test_whole_files_are_rows_of_their_own(spark, tmp_path):
    register_folders(spark)
    rows = spark.createDataFrame([("a", bytearray(b"1")), ("b/c", bytearray(b"")), ("d", None)], "path string, content binary")
    write_files(rows, "folder", str(tmp_path))
    assert found(FolderAdapter(str(tmp_path))) == {"a": "1", "b/": None, "b/c": "", "d": ""}
    with pytest.raises(Exception, match="1 paths were written"):
        write_files(spark.createDataFrame([("a", bytearray(b"2")), ("a", bytearray(b"3"))], rows.schema).coalesce(1), "folder", str(tmp_path))
    assert found(FolderAdapter(str(tmp_path)))["a"] == "1" and FolderAdapter(str(tmp_path)).list(".vfs/stage") == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_texts_move_once_at_most(spark):
    """What the folder's query shuffles, its entries included, is less than twice the texts, also where nothing is broadcast."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        time.sleep(1)  # the status follows the tasks
        return sum(store.executorList(False).apply(i).totalShuffleWrite() for i in range(store.executorList(False).size()))

    texts_ = spark.read.parquet(f"{SF}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        assert queries.QUERIES["applied_folder"](spark, SF).filter("hash is not null").count() == 939
        moved = shuffled() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < moved < 2 * texts_, (moved, texts_)
