"""Stores by Spark's data source interface: folders, a store of one's own, ranges, writes that are carried out whole or not at all."""

import hashlib
import io
import json
import os
import pickle
import random
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.sources.adapter import BLOCK, Adapter, Entry, FolderAdapter, _Writer, file_digests, range_digests, register, register_folders, repeated, subtrees, tree_digests, walk_store, write_files

cloudpickle.register_pickle_by_value(sys.modules[__name__])
PARTS = "path string, start long, content binary"


class OneFile(Adapter):
    """A store of one's own: all files in one JSON document, names to hex."""

    def __init__(self, at):
        self.at = at

    def _all(self):
        with open(self.at) as f:
            return json.load(f)

    def _put(self, files):
        with open(self.at + ".new", "w") as f:
            json.dump(files, f)
        os.replace(self.at + ".new", self.at)

    def list(self, path):
        base, out = path + "/" if path else "", {}
        for p, x in self._all().items():
            if p.startswith(base):
                name, _, rest = p[len(base) :].partition("/")
                out[base + name] = Entry(base + name, "directory") if rest else Entry(p, "file", len(x) // 2, 7)
        return list(out.values())

    def stat(self, path):
        return next((e for e in self.list(path.rpartition("/")[0]) if e.path == path), None)

    def open(self, path):
        return io.BytesIO(bytes.fromhex(self._all()[path]))

    def create(self, path):
        store = self

        class Sink(io.BytesIO):
            def close(self):
                if not self.closed:
                    store._put(store._all() | {path: self.getvalue().hex()})
                super().close()

        return Sink()

    def rename(self, path, to):
        self._put({to + p[len(path) :] if p == path or p.startswith(path + "/") else p: x for p, x in self._all().items() if p != to})

    def delete(self, path):
        self._put({p: x for p, x in self._all().items() if p != path and not p.startswith(path + "/")})

    def file_id(self, path):
        return "id-" + path


FILES = {"a/b/c.txt": b"one", "a/d.bin": b"", "e.md": b"two three", "a/b2/x": b"x" * 10}


@pytest.fixture(params=["folder", "one"])
def store(request, spark, tmp_path):
    register_folders(spark)
    register(spark, "one", lambda options: OneFile(options["at"]))
    at = str(tmp_path / "s")
    if request.param == "folder":
        return request.param, {}, at, FolderAdapter(at)
    with open(at, "w") as f:
        f.write("{}")
    return request.param, {"at": at}, None, OneFile(at)


def test_contract(spark, store):
    name, options, path, adapter = store
    rows = spark.createDataFrame([(p, 0, bytearray(c)) for p, c in FILES.items()], PARTS)
    write_files(rows.coalesce(1), name, path, **options)
    read = lambda **o: spark.read.format(name).options(**options, **o).load(path)
    assert {r["path"]: (r["size"], bytes(r["content"])) for r in read(content="whole").filter("kind = 'file'").collect()} == {p: (len(c), c) for p, c in FILES.items()}
    assert sorted(r["path"] for r in read().filter("kind = 'directory'").collect()) == ["a", "a/b", "a/b2"]
    assert [r["path"] for r in walk_store(spark, name, path, **options).collect()] == sorted(FILES)
    assert [r["path"] for r in walk_store(spark, name, path, ignore=F.col("path") == "a/b", directories=True, **options).collect()] == ["a", "a/b2", "a/b2/x", "a/d.bin", "e.md"]
    assert sorted(r["path"] for r in read(prefix="a/b").filter("kind = 'file'").collect()) == ["a/b/c.txt", "a/b2/x"]
    assert sorted(p.path for p in subtrees(adapter, "a/b2/", 9)) == ["", "a", "a/b2"]
    # what a store must do by itself
    assert adapter.list("nowhere") == [] and adapter.stat("nowhere") is None and adapter.stat("e.md").size == 9
    assert b"".join(adapter.read("e.md", 4, 9)) == b"three" and b"".join(adapter.read("e.md", 5, 100)) == b"hree" and b"".join(adapter.read("e.md", 5, 2)) == b""
    adapter.rename("a/b", "m/n")
    adapter.delete("a/d.bin")
    adapter.delete("a/d.bin")
    assert [r["path"] for r in walk_store(spark, name, path, **options).collect()] == ["a/b2/x", "e.md", "m/n/c.txt"]
    with pytest.raises(Exception, match="nowhere"):
        list(adapter.read("nowhere"))
    # parts of one file, in order, in place of what was there
    parts = spark.createDataFrame([("e.md", 10 * i, bytearray(bytes([48 + i]) * 10)) for i in range(9, -1, -1)], PARTS)
    write_files(parts.repartition(3), name, path, **options)
    assert b"".join(adapter.read("e.md")) == b"".join(bytes([48 + i]) * 10 for i in range(10))
    assert adapter.list(".vfs/stage") == []


def test_aborted_write_leaves_nothing(spark, store):
    name, options, path, adapter = store
    adapter.create("old").close()
    rows = spark.createDataFrame([("new", 0, bytearray(b"x")), ("old", 0, bytearray(b"y"))], PARTS)
    broken = rows.withColumn("content", F.when(F.col("path") == "old", F.raise_error(F.lit("torn")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="torn"):
        write_files(broken.coalesce(1), name, path, **options)
    assert [e.path for e in adapter.list("") if e.path != ".vfs"] == ["old"] and adapter.list(".vfs/stage") == [] and b"".join(adapter.read("old")) == b""
    for bad in ("../x", "/x", ".vfs/y", ""):
        with pytest.raises(Exception, match="not a path to write"):
            write_files(spark.createDataFrame([(bad, 0, bytearray(b"x"))], PARTS), name, path, **options)


def test_ranges(spark, tmp_path):
    register_folders(spark)
    adapter, data = FolderAdapter(str(tmp_path)), random.Random(1).randbytes(7 * BLOCK - 5)
    for n, c in (("big", data), ("exact", data[: 2 * BLOCK]), ("empty", b""), ("small", b"abc")):
        with adapter.create(f"d/{n}") as f:
            f.write(c)
    read = spark.read.format("folder").option("content", "ranges").option("size", str(BLOCK)).load(str(tmp_path))
    assert read.rdd.getNumPartitions() == 7 + 2 + 1 + 1  # a task a range
    found = {(r["path"], r["start"]): (r["end"], r["digest"]) for r in range_digests(read, BLOCK).collect()}
    wanted = {(f"d/{n}", at): (min(len(c), at + BLOCK), hashlib.sha256(c[at : at + BLOCK]).hexdigest()) for n, c in (("big", data), ("exact", data[: 2 * BLOCK]), ("empty", b""), ("small", b"abc")) for at in range(0, max(1, len(c)), BLOCK)}
    assert found == wanted
    wide = spark.read.format("folder").option("content", "ranges").option("size", str(3 * BLOCK + 1)).load(str(tmp_path)).filter("path = 'd/big'")
    rows = wide.orderBy("start").collect()
    assert b"".join(bytes(r["content"]) for r in rows) == data and max(len(r["content"]) for r in rows) <= BLOCK
    trees = {r["path"]: (r["size"], r["digest"]) for r in tree_digests(range_digests(read, BLOCK)).collect()}
    assert trees["d/small"] == (3, hashlib.sha256(hashlib.sha256(b"abc").hexdigest().encode()).hexdigest()) and trees["d/big"][0] == len(data) and len(trees) == 4
    files = spark.read.format("folder").load(str(tmp_path)).filter("kind = 'file'")
    assert {r["path"]: r["hash"] for r in file_digests(files, adapter).collect()} == {"d/big": hashlib.sha256(data).hexdigest(), "d/exact": hashlib.sha256(data[: 2 * BLOCK]).hexdigest(), "d/empty": hashlib.sha256().hexdigest(), "d/small": hashlib.sha256(b"abc").hexdigest()}


def test_only_directories_of_the_prefix_are_listed(spark, tmp_path):
    register_folders(spark)
    adapter = FolderAdapter(str(tmp_path))
    for p in ("a/x", "a/y", "b/x"):
        adapter.create(p).close()
    adapter.mkdir("c/empty")
    df = spark.read.format("folder").option("subtrees", "9").load(str(tmp_path))
    some = spark.read.format("folder").option("prefix", "a/").option("subtrees", "9").load(str(tmp_path))
    assert sorted(r["path"] for r in some.collect()) == ["a/x", "a/y"] and (some.rdd.getNumPartitions(), df.rdd.getNumPartitions()) == (2, 5)
    assert [r["path"] for r in walk_store(spark, "folder", str(tmp_path), directories=True).collect()] == ["a", "a/x", "a/y", "b", "b/x", "c", "c/empty"]


def test_parts_are_written_as_they_come(tmp_path):
    rows = [("a", b"1"), ("a", b""), ("a", None), ("a", b"2"), ("b/c", None), ("d", b"x" * 70_000)]
    batches = [pa.RecordBatch.from_pydict({"path": [p for p, _ in part], "start": [0] * len(part), "content": pa.array([c for _, c in part], pa.binary())}) for part in (rows[:2], rows[2:5], rows[5:])]
    writer = _Writer(FolderAdapter(str(tmp_path)), ["path", "start", "content"])
    writer.commit([writer.write(iter(batches))])
    assert {p: (tmp_path / p).read_bytes() for p in ("a", "b/c", "d")} == {"a": b"12", "b/c": b"", "d": b"x" * 70_000}


def test_what_a_task_tells_does_not_grow(tmp_path):
    """Where its files belong stands in the stage, not in the message to the driver."""
    names = [f"d{i % 7}/line\n{i} ü" for i in range(2000)]
    writer = _Writer(FolderAdapter(str(tmp_path)), ["path", "content"], whole=True)
    said = [writer.write(iter([pa.RecordBatch.from_pydict({"path": part, "content": pa.array([b"x"] * len(part), pa.binary())})])) for part in (names[:5], names[5:], [])]
    assert len({len(pickle.dumps(m)) for m in said[:2]}) == 1 and len(pickle.dumps(said[1])) < 300
    writer.commit([*said, None])
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("line*")) == sorted(names) and FolderAdapter(str(tmp_path)).list(".vfs/stage") == []
    assert repeated(lambda: iter(names)) == 0 and repeated(lambda: iter(names + names[:3] + names[:1])) == 4 and repeated(lambda: iter(())) == 0
