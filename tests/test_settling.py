"""Pending conflicts settled by uuid, and a stream that syncs."""

import pytest

from tidemark.operators.contents import resolve_pending
from tidemark.streaming.auto_sync import auto_sync


def test_resolve_pending(spark):
    entries = spark.createDataFrame([("1", "n.md", None, None), ("c", "n (conflict).md", "1", None), ("h", "far.md", "1", "b"), ("g", "lone.md", "gone", None)], "uuid string, path string, conflict_of string, held string")
    files = spark.createDataFrame([("n.md", "file", 4, bytearray(b"mine")), ("n (conflict).md", "file", 6, bytearray(b"theirs")), ("lone.md", "file", 1, bytearray(b"x"))], "path string, kind string, size long, content binary")
    left = lambda uuid, choice: {r["path"]: bytes(r["content"]) for r in resolve_pending(files, entries, uuid, choice, "a").collect()}
    assert left("c", "mine") == {"n.md": b"mine", "lone.md": b"x"} and left("c", "theirs") == {"n.md": b"theirs", "lone.md": b"x"}
    assert left("c", b"both") == {"n.md": b"both", "lone.md": b"x"} and set(left("g", "theirs")) == {"n.md", "n (conflict).md"}
    assert left("h", "mine") == {r["path"]: bytes(r["content"]) for r in files.collect()}
    with pytest.raises(ValueError, match="held on b"):
        left("h", "theirs")
    with pytest.raises(KeyError, match="no pending conflict"):
        left("1", "mine")
    with pytest.raises(ValueError, match="choice"):
        left("c", "ours")


def test_auto_sync(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ran = []
    run = lambda: auto_sync(spark.readStream.text(str(tmp_path / "in")), ran.append, str(tmp_path / "c")).awaitTermination(60)
    run()
    (tmp_path / "in" / "1.txt").write_text("changed\n")
    (tmp_path / "in" / "2.txt").write_text("changed\n")
    run()
    run()
    assert len(ran) == 1
    (tmp_path / "in" / "3.txt").write_text("changed\n")
    run()
    assert len(ran) == 2
