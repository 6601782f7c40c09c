import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import digests, display, paths
from tidemark.schema import EMPTY_STATE


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "wanted"), [("/a//b/./c/", "a/b/c"), ("", ""), ("./", ""), ("a\\b\\c.txt", "a/b/c.txt"), ("a/b/../c", "a/c"), ("a/b/../../c", "c")])
def test_normalize(spark, given, wanted):
    assert one(spark, paths.normalize(F.col("p")), p=given) == wanted


@pytest.mark.parametrize("given", ["../outside", "a/../../outside"])
def test_normalize_leaves_root(spark, given):
    with pytest.raises(Exception, match="leaves the root"):
        one(spark, paths.normalize(F.col("p")), p=given)


def test_names(spark):
    p = F.col("p")
    rows = spark.createDataFrame([("a/b/c.txt",), ("c.txt",), ("archive.tar.gz",), ("LICENSE",), (".gitignore",), ("a/b/Catalogue.XML",)], "p string")
    out = rows.select(paths.dirname(p), paths.basename(p), paths.stem(paths.basename(p)), paths.suffix(paths.basename(p)), paths.extension(p)).collect()
    assert [tuple(r) for r in out] == [("a/b", "c.txt", "c", ".txt", "txt"), ("", "c.txt", "c", ".txt", "txt"), ("", "archive.tar.gz", "archive.tar", ".gz", "gz"), ("", "LICENSE", "LICENSE", "", ""), ("", ".gitignore", ".gitignore", "", ""), ("a/b", "Catalogue.XML", "Catalogue", ".XML", "xml")]


def test_inside_and_ancestors(spark):
    rows = spark.createDataFrame([("a/b/c", "a/b"), ("a/b", "a/b"), ("x", ""), ("a/bc", "a/b")], "p string, d string")
    assert [r[0] for r in rows.select(paths.is_inside(F.col("p"), F.col("d"))).collect()] == [True, True, True, False]
    assert one(spark, paths.ancestors(F.col("p")), p="a/b/c") == ["a", "a/b"]
    assert one(spark, paths.ancestors(F.col("p")), p="c") == []


def test_conflict_name(spark):
    assert one(spark, paths.conflict_name(F.col("p"), F.lit("device-b"), F.lit("77be01d90000")), p="docs/notes.md") == "docs/notes (conflict device-b 77be01d9).md"


def test_names_with_line_feeds(spark):
    p = F.col("p")
    rows = spark.createDataFrame([("dir\nx/name.tXt",), ("a/b\n",), ("a/x.\n",)], "p string")
    out = rows.select(paths.dirname(p), paths.basename(p), paths.stem(paths.basename(p)), paths.suffix(paths.basename(p)), paths.extension(p), paths.conflict_name(p, F.lit("b"), F.lit("77be01d90"))).collect()
    assert [tuple(r) for r in out] == [
        ("dir\nx", "name.tXt", "name", ".tXt", "txt", "dir\nx/name (conflict b 77be01d9).tXt"), ("a", "b\n", "b\n", "", "", "a/b\n (conflict b 77be01d9)"), ("a", "x.\n", "x", ".\n", "\n", "a/x (conflict b 77be01d9).\n")]


def test_order_of_code_units(spark):
    rows = spark.createDataFrame([("\ufffd",), ("😀",), ("a",)], "p string")
    assert [r[0] for r in rows.orderBy(paths.sort_key(F.col("p"))).collect()] == ["a", "😀", "\ufffd"]
    e = spark.createDataFrame([("\ufffd", "1"), ("😀", "2")], "p string, u string")
    assert e.agg(digests.state_digest(F.col("p"), F.col("u"), F.col("u"))).first()[0] == hashlib.sha256(b"[2,1]").hexdigest()


def test_control_characters_in_json(spark):
    c = F.col("p")
    path = "a\x1f\x0b\x01\n\\u000B é\x7f"
    j = one(spark, digests.entry_json(F.lit("file"), c, F.lit(None).cast("string"), F.lit(1), F.lit(2), F.lit("u")), p=path)
    assert j == '{"hash":null,"kind":"file","path":' + json.dumps(path, ensure_ascii=False) + ',"size":1,"updated":2,"uuid":"u"}'


def test_xor(spark):
    ids = [hashlib.sha256(x).hexdigest() for x in (b"p", b"q", b"r")]
    rows = spark.createDataFrame([(i,) for i in ids], "op string")
    wanted = f"{int(ids[0], 16) ^ int(ids[1], 16) ^ int(ids[2], 16):064x}"
    assert rows.agg(digests.xor_digest(F.col("op"))).first()[0] == wanted
    assert rows.limit(0).agg(digests.xor_digest(F.col("op"))).first()[0] == "0" * 64
    assert one(spark, digests.xor_hex(F.lit(ids[0]), F.lit("zz"))) == ids[0]
    twice = digests.xor_hex(digests.xor_hex(F.lit(ids[0]), F.lit(ids[1])), F.lit(ids[1]))
    assert one(spark, twice) == ids[0]


def test_empty_state(spark):
    none = spark.createDataFrame([], "path string, uuid string, j string")
    assert none.agg(digests.state_digest(F.col("path"), F.col("uuid"), F.col("j"))).first()[0] == EMPTY_STATE


def test_display(spark):
    rows = spark.createDataFrame([("a/LICENSE",), (".env",), ("x.PNG",), ("x.md",), ("x.unknown",), ("a.d/x",)], "p string")
    assert [r[0] for r in rows.select(display.mime(F.col("p"))).collect()] == ["text/plain", "text/plain", "image/png", "text/markdown", "application/octet-stream", "application/octet-stream"]
    sizes = spark.createDataFrame([(0,), (1,), (1023,), (1024,), (1234,), (10_752,), (5_000_000,)], "n long")
    assert [r[0] for r in sizes.select(display.format_bytes(F.col("n"))).collect()] == ["0 bytes", "1 byte", "1023 bytes", "1.0 KB", "1.2 KB", "11 KB", "4.8 MB"]
    assert one(spark, display.format_size(F.lit(1234))) == "1.2 KB (1,234 bytes)"
    assert one(spark, display.format_ago(F.lit(10_000), F.lit(0))) == "0s ago"
    assert one(spark, display.looks_textual(F.lit("a\tb\n"))) is True
    assert one(spark, display.looks_textual(F.lit("a\x01"))) is False
