"""Appends that race: no row is lost, none comes twice, readers stay with their version."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tidemark.sources.manifest import create_absent, open_table

ROW = "op string, n int"


def rows(spark, *ops):
    return spark.createDataFrame([(o, i) for i, o in enumerate(ops)], ROW)


def ops(df):
    return sorted(r["op"] for r in df.collect())


def test_one_writer(spark, tmp_path):
    t = open_table(spark, str(tmp_path), ROW)
    assert t.latest() == 0 and ops(t.read()) == []
    assert t.append(rows(spark, "a", "b", "a"), "op") == 1 and t.append(rows(spark, "b", "c"), "op") == 2 and t.append(rows(spark, "c"), "op") == 2
    assert ops(t.read()) == ["a", "b", "c"] and ops(t.read(1)) == ["a", "b"] and ops(t.read(after=1)) == ["c"]
    assert t.append(rows(spark, "a")) == 3 and ops(t.read()) == ["a", "a", "b", "c"]
    assert t.compact() == 4 and len(t.parts(4)) == 1 and ops(t.read()) == ["a", "a", "b", "c"]


@pytest.mark.parametrize("shared", [True, False])
def test_a_lost_race(spark, tmp_path, shared):
    t = open_table(spark, str(tmp_path), ROW)
    seen = t.read()
    winner = lambda n: t.append(rows(spark, *(("b", "x") if shared else ("x",))), "op") if n == 1 else None
    assert t.append(rows(spark, "a", "b"), "op", before_commit=winner) == 2
    assert ops(t.read()) == ["a", "b", "x"] and ops(t.read(1)) == (["b", "x"] if shared else ["x"]) and ops(seen) == []
    assert t.compact(before_commit=lambda n: t.append(rows(spark, "late"), "op") if t.latest() == 2 else None) is None and "late" in ops(t.read())


def test_many_at_once(spark, tmp_path):
    t = open_table(spark, "file://" + str(tmp_path), ROW)
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda i: t.append(rows(spark, f"w{i}", "all"), "op"), range(4)))
    assert sorted(found) == [1, 2, 3, 4] and ops(t.read()) == ["all", "w0", "w1", "w2", "w3"]


def test_a_name_is_made_once(spark, tmp_path):
    name = str(tmp_path / "d" / "x")
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: create_absent(spark, name, str(i).encode()), range(40)))
    assert sum(made) == 1 and (tmp_path / "d" / "x").read_text() == str(made.index(True)) and [p.name for p in (tmp_path / "d").iterdir()] == ["x"]
