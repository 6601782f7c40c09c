import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import contents, snapshot
from tidemark.operators.merge import entry_rows
from tidemark.operators.textmerge import endings, merge_texts, split_lines
from tidemark.sources.feed import external_changes, read_changes, stream_changes
from tidemark.sources.files import decode_text, encode_rows, read_log, walk
from tidemark.streaming.log_stream import log_stream, read_latest, upsert_latest

LINES = lambda *x: "".join(f"{v}\n" for v in x)


@pytest.mark.parametrize(
    ("base", "a", "b", "wanted"),
    [
        (LINES("one", "two", "three"), LINES("ONE", "two", "three"), LINES("one", "two", "THREE"), LINES("ONE", "two", "THREE")),
        (LINES("one", "two", "three"), LINES("one", "two", "three", "four"), LINES("two", "three"), LINES("two", "three", "four")),
        (LINES("one", "two", "three"), LINES("one", "TWO", "three"), LINES("one", "TWO", "three"), LINES("one", "TWO", "three")),
        (LINES("one", "two", "three"), LINES("one", "LEFT", "three"), LINES("one", "RIGHT", "three"), "block"),
        (LINES("a", "b", "c"), LINES("a", "B1", "c"), LINES("a", "b", "C1"), LINES("a", "B1", "C1")),
        (LINES("a", "b", "c"), LINES("b", "a", "c"), LINES("a", "b", "c", "d"), LINES("b", "a", "c", "d")),
        (LINES("a", "b"), LINES("x", "y"), LINES("a", "b"), LINES("x", "y")),
        (LINES("a", "b"), "x\n", "y\n", "block"),
        ("a\nb\n", "a\r\nb\r\n", "a\nb\n", "eol"),
        ("a\n", "x" * (1 << 20) + "y", "a\n", "size"),
        (LINES(*range(2100)), LINES(*range(5000, 7100)), LINES(*range(2100)), "size"),
        ("", "", "", ""),
    ],
)
def test_diff3(base, a, b, wanted):
    ok, text, reason = merge_texts(base, a, b)
    assert (text if ok else reason) == wanted


def test_lines():
    assert split_lines("a\r\nb\nc") == ["a\r\n", "b\n", "c"] and split_lines("") == []
    assert [endings(x) for x in ("a", "a\n", "a\r\n", "a\r\nb\n")] == ["none", "lf", "crlf", "mixed"]


FILES = "path string, kind string, size long, mtime long, hash string, native string"


def scan(spark, files, known, renames=None, at=2000):
    e = spark.createDataFrame(known, "uuid string, path string, hash string, native string")
    e = entry_rows(e.withColumns({"kind": F.lit("file"), "size": F.lit(1), "created": F.lit(1), "updated": F.lit(1000), "peer": F.lit("p")})).join(e.select("uuid", "native"), "uuid").withColumn("mtime", F.lit(1).cast("bigint"))
    r = spark.createDataFrame([("s", i, *x) for i, x in enumerate(renames)], "store string, seq int, from_path string, to_path string") if renames else None
    f = spark.createDataFrame([(p, "file", 1, 1, h, n) for p, h, n in files], FILES)
    out, rows = snapshot.scan(f, e, "me", at, r, new_uuid=lambda p: F.concat(F.lit("new:"), p))
    return {x["path"]: x for x in out.filter("not deleted").collect()}, {(x["uuid"], x["type"]) for x in rows.collect()}


def test_quiet_scan(spark):
    out, rows = scan(spark, [("a", "h", None)], [("1", "a", "h", None)])
    assert out["a"]["uuid"] == "1" and out["a"]["updated"] == 1000 and not rows


def test_swap_by_way_of_a_third_name(spark):
    out, rows = scan(spark, [("a", "hb", None), ("b", "ha", None)], [("1", "a", "ha", None), ("2", "b", "hb", None)], [("a", "t"), ("b", "a"), ("t", "b")])
    assert out["a"]["uuid"] == "2" and out["b"]["uuid"] == "1" and rows == {("1", "rename"), ("2", "rename")}


def test_old_name_used_again(spark):
    out, rows = scan(spark, [("b", "h", None), ("a", "other", None)], [("1", "a", "h", None)], [("a", "b")])
    assert out["b"]["uuid"] == "1" and out["a"]["uuid"] == "new:a" and out["b"]["prev_path"] == "a"
    assert rows == {("1", "rename"), ("new:a", "write")}


def test_move_without_a_word(spark):
    out, rows = scan(spark, [("z", "h", None), ("y", "h", None)], [("1", "a", "h", None)])
    assert out["y"]["uuid"] == "1" and out["z"]["uuid"] == "new:z" and out["y"]["prev_path"] == "a"
    assert rows == {("1", "rename"), ("new:z", "write")}


def test_native_ids_come_first(spark):
    out, _ = scan(spark, [("b", "x", "n1")], [("1", "a", "h", "n1")])
    assert out["b"]["uuid"] == "1" and out["b"]["prev"] == "h"


def test_delete(spark):
    out, rows = scan(spark, [], [("1", "a", "h", None)])
    assert not out and rows == {("1", "delete")}


def test_walk_log_and_feed(spark, tmp_path):
    for name, text in {"r/a.txt": "x", "r/d/b.md": "yy", "r/.vfs/vfs.json": "{}", "r/skip/c": "z"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    seen = walk(spark, str(tmp_path / "r"), ignore=F.col("path") == "skip", directories=True).collect()
    assert {(x["path"], x["kind"], x["size"]) for x in seen} == {("a.txt", "file", 1), ("d/b.md", "file", 2), ("d", "directory", 0)}
    (tmp_path / "log").mkdir()
    row = {"op": "o", "uuid": "1", "at": 5, "type": "write", "path": "p", "prevPath": "q"}
    (tmp_path / "log/c1").write_text(json.dumps(row) + "\n\n{\"op\": \"torn\n" + json.dumps(row | {"op": "o2", "at": 6}) + "\n")
    log = read_log(spark, str(tmp_path / "log"))
    assert {(x["op"], x["at_ms"], x["prev_path"]) for x in log.collect()} == {("o", 5, "q"), ("o2", 6, "q")}
    assert json.loads(encode_rows(log).filter("value like '%\"o\"%'").first()["value"]) == row
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed/0001.ndjson").write_text('{"native": "n", "size": 1, "mtime": 1}\n{"path": "x", "removed": true}\n{"path": ".vfs/y"}\n{"path": "new"}\n')
    folder = str(tmp_path / "feed")
    assert read_changes(spark, folder, None) == (None, "0001.ndjson") and read_changes(spark, folder, "0000.ndjson") == (None, "0001.ndjson")
    assert read_changes(spark, folder, "0001.ndjson")[0].count() == 0
    feed, token = read_changes(spark, folder, "")
    assert token == "0001.ndjson" and stream_changes(spark, folder).columns == feed.columns
    known = spark.createDataFrame([("n", "p", 1, 1, False)], "native string, path string, size long, mtime long, deleted boolean")
    assert [r["path"] for r in external_changes(feed, known).collect()] == ["new"]


def test_streamed_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    rows = [{"op": f"o{i}", "uuid": str(i % 2), "at": i, "type": "delete" if i == 3 else "write", "path": f"p{i}"} for i in range(4)]
    (tmp_path / "log/c1").write_text("".join(json.dumps(r) + "\n" for r in rows + rows[:2]))
    upsert_latest(log_stream(spark, str(tmp_path / "log")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert {(r["uuid"], r["path"], r["deleted"]) for r in read_latest(spark, str(tmp_path / "t")).collect()} == {("0", "p2", False), ("1", "p3", True)}
    for i in range(4, 9):
        (tmp_path / f"log/c{i}").write_text(json.dumps({"op": f"o{i}", "uuid": "0", "at": i, "type": "write", "path": f"p{i}"}) + "\n")
        upsert_latest(log_stream(spark, str(tmp_path / "log")), str(tmp_path / "t"), str(tmp_path / "c"), compact=2).awaitTermination()
    assert {(r["uuid"], r["path"], r["deleted"]) for r in read_latest(spark, str(tmp_path / "t")).collect()} == {("0", "p8", False), ("1", "p3", True)}
    assert {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()} >= {"base-4"} and not (tmp_path / "t/delta-1").exists()


def test_bytes(spark):
    files = spark.createDataFrame([("a", bytearray(b"hello world")), ("b", bytearray(b""))], "path string, content binary")
    back = contents.collect_chunks(contents.chunks(files, 4)).collect()
    assert [(r["path"], bytes(r["content"])) for r in sorted(back)] == [("a", b"hello world"), ("b", b"")]
    assert bytes(files.select(contents.byte_range(F.col("content"), 6, 99)).first()[0]) == b"world"
    raw = spark.createDataFrame([(bytearray(b"\xef\xbb\xbfa\xff"),)], "c binary")
    assert raw.select(decode_text(F.col("c"))).first()[0] == "a�"
    target = spark.createDataFrame([("p", "file", "nope", 1, False)], "path string, kind string, hash string, size long, deleted boolean")
    with pytest.raises(Exception, match="wrong or missing content"):
        contents.apply_target(target, spark.createDataFrame([("nope", bytearray(b"x"))], "hash string, content binary"), "me").collect()


def test_folder_edits(spark):
    from tidemark.operators import edits

    files = spark.createDataFrame([("a/x", "file", 1, bytearray(b"1")), ("ab", "file", 1, bytearray(b"2")), (".vfs/s", "file", 1, bytearray(b"3"))], "path string, kind string, size long, content binary")
    names = lambda df: {(r["path"], r["kind"], bytes(r["content"] or b"")) for r in df.collect()}
    assert names(edits.rename_path(files, "a", "c/d")) == {("c/d/x", "file", b"1"), ("ab", "file", b"2"), (".vfs/s", "file", b"3")}
    assert names(edits.delete_path(files, "a")) == {("ab", "file", b"2"), (".vfs/s", "file", b"3")} == names(edits.delete_path(edits.delete_path(files, "a"), "a"))
    assert ("ab", "file", b"new") in names(edits.write_file(files, "ab", b"new")) and edits.write_file(files, "ab", b"new").count() == 3
    assert {x[0] for x in names(edits.make_dir(files, "p/q")) if x[1] == "directory"} == {"p", "p/q"}
    for path in ("", ".vfs", ".vfs/s", "../x"):
        with pytest.raises(ValueError, match="not a path"):
            edits.delete_path(files, path)
    with pytest.raises(ValueError, match="no such conflict"):
        contents.resolve_conflict(files, "a/x", "gone", "mine")


def test_store_lines_headers_and_counts(spark, tmp_path):
    from tidemark.sources.files import list_dir, observed, read_entries, read_header, stat, write_entries

    doc = {"version": 2, "storeId": "s", "peer": "p", "text": ["md"], "peers": {"q": {"lastSync": 5}}, "log": {"segment": 1, "rows": 2}, "entries": [{"uuid": "1", "kind": "file", "path": "a/b.md", "hash": "h", "size": 1, "created": 1, "updated": 2, "peer": "p", "prevPath": "c"}]}
    (tmp_path / "vfs.json").write_text(json.dumps(doc))
    head = read_header(spark, str(tmp_path / "vfs.json")).first()
    assert head["storeId"] == "s" and head["peers"]["q"]["lastSync"] == 5 and head["log"]["rows"] == 2
    rows = read_entries(spark, str(tmp_path / "vfs.json"))
    assert rows.first()["prev_path"] == "c" and rows.first()["deleted"] is False
    write_entries(rows, str(tmp_path / "lines"))
    assert [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "lines")).collect()] == doc["entries"]
    files = rows.select("path", "kind", "size", F.lit(3).alias("mtime"))
    assert list_dir(files, "a").count() == 1 and list_dir(files, "b").count() == 0 and tuple(stat(files, "a/b.md").first()) == ("file", 1, 3) and stat(files, "x").first() is None
    counted, seen = observed(files, "copied")
    counted.collect()
    assert seen.get == {"rows": 1, "bytes": 1}
