"""What questions about histories write: bytes for each version, however long the history."""

import hashlib
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ancestry, lineage
from tidemark.plans.scratch import Scratch

FILES, LONG = 100, 40


@pytest.fixture
def written(monkeypatch):
    sizes, save = [], Scratch.save

    def counted(self, df, name, *args, **kw):
        out = save(self, df, name, *args, **kw)
        top = f"{self.root}/{name}".removeprefix("file://")
        sizes.append(sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(top) for f in fs))
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    return lambda: sum(sizes) / (FILES * LONG)


def version(f, i):
    return hashlib.sha256(f"{f}/{i}".encode()).hexdigest() if i >= 0 else None


def history(spark):
    """Straight histories: what was read back has no plan that knows it."""
    rows = [(f"file-{f:05}", version(f, i), version(f, i - 1), version(f, i - 2), version(f, i - 3)) for f in range(FILES) for i in range(LONG)]
    df = spark.createDataFrame(rows, "uuid string, hash string, prev string, second string, third string")
    return df, ancestry.version_edges(df)


def test_common_ancestors(spark, written):
    log, edges = history(spark)
    pairs = log.filter("second is not null").select("uuid", F.col("hash").alias("left"), F.col("second").alias("right"))
    got = ancestry.common_ancestor(pairs, edges).join(log.select("uuid", F.col("hash").alias("left"), "third"), ["uuid", "left"])
    assert got.filter("base is distinct from third").isEmpty() and got.count() == FILES * (LONG - 2) and written() < 500


def test_descent(spark, written):
    log, edges = history(spark)
    pairs = log.select("uuid", "hash", "prev", F.lit(None).cast("string").alias("prev2"), F.col("third").alias("ancestor"))
    got = ancestry.descends(pairs, edges)
    assert got.filter("descends").count() == FILES * (LONG - 3) and got.count() == FILES * LONG and written() < 500


def test_climbing(spark, written):
    _, edges = history(spark)
    heads = spark.createDataFrame([(f"file-{f:05}", version(f, LONG - 1), version(f, LONG - 1)) for f in range(FILES)], "uuid string, start string, node string")
    got = ancestry.climb(heads, edges)
    assert {(r["uuid"], r["node"], r["depth"], r["path"]) for r in got.collect()} == {(f"file-{f:05}", version(f, LONG - 1 - i), i, "0" * i) for f in range(FILES) for i in range(LONG)}
    assert written() < 400


def test_by_runs(spark, written):
    log, edges = history(spark)
    pairs = log.filter("second is not null").select("uuid", F.col("hash").alias("left"), F.col("second").alias("right"))
    assert lineage.common_ancestor(pairs, lineage.runs(edges)).filter("base is not null").count() == FILES * (LONG - 3) and written() < 800


def test_descent_by_runs(spark, written):
    log, edges = history(spark)
    pairs = log.select("uuid", "hash", "prev", F.lit(None).cast("string").alias("prev2"), F.col("third").alias("ancestor"))
    assert lineage.descends(pairs, lineage.runs(edges)).filter("descends").count() == FILES * (LONG - 3) and written() < 800


def test_a_lineage_that_grows(spark, written, tmp_path):
    _, edges = history(spark)
    late = F.crc32("hash") % 10 >= 7
    kept = lineage.Lineage(spark, str(tmp_path / "l"))
    kept.append(edges.filter(~late))
    kept.append(edges)
    got = kept.versions()
    assert got.filter("place = 0").count() == FILES and got.count() == FILES * LONG and got.groupBy("uuid").agg(F.max("place").alias("m")).filter(f"m <> {LONG - 1}").isEmpty()
    assert written() < 500


def test_a_task_follows_its_own_edges(monkeypatch):
    key = lambda i: i.to_bytes(16, "big")
    ring = [(900, 901), (901, 902), (902, 900)]
    pairs = [(i, i - 1) for i in range(200, 0, -1)]
    monkeypatch.setattr(ancestry, "BLOCK", 64)

    def follow(pairs):
        batches = (pa.record_batch({"u": [1] * len(x), "node": [key(a) for a, _ in x], "up": [key(b) for _, b in x]}) for x in (pairs[i : i + 32] for i in range(0, len(pairs), 32)))
        return [(int.from_bytes(r["node"], "big"), int.from_bytes(r["at"], "big"), r["steps"]) for b in ancestry._follow(batches) for r in b.to_pylist()]

    assert follow(pairs) == [(n, n - s, s) for k, (n, _) in enumerate(pairs) for s in [min(64 - k % 64, n)]]
    assert [n for n, _, _ in follow(ring + pairs)] == [n for n, _ in ring + pairs]


@pytest.fixture
def tables(monkeypatch):
    names, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, *args, **kw: (names.append(name), save(self, df, name, *args, **kw))[1])
    return names


def test_descent_takes_a_round(spark, tables):
    log, edges = history(spark)
    pairs = log.select("uuid", "hash", "prev", F.lit(None).cast("string").alias("prev2"), F.col("third").alias("ancestor"))
    assert ancestry.descends(pairs, edges).filter("descends").count() == FILES * (LONG - 3)
    assert [n for n in tables if n.startswith("round-")] == ["round-0", "round-1"]


def test_runs_move_names_once(spark, tables, written):
    """What a question by runs needs: edges, their stretches and places, and the runs."""
    _, edges = history(spark)
    assert lineage.runs(edges).count() == FILES * LONG
    assert tables == ["edges", "round-0", "round-1", "result"]


def test_descent_by_runs_takes_a_round(spark, tables):
    log, edges = history(spark)
    pairs = log.select("uuid", "hash", "prev", F.lit(None).cast("string").alias("prev2"), F.col("third").alias("ancestor"))
    assert lineage.descends(pairs, lineage.runs(edges)).filter("descends").count() == FILES * (LONG - 3)
    assert [n for n in tables if n.startswith("round-")] == ["round-0", "round-1"]


def reached(rows, edges, aimed):
    """Breadth first, one start at a time."""
    out = set()
    for uuid, tag, target, node in rows:
        best, level = {node: (0, "")}, [node]
        while level:
            new = {}
            for v in level:
                for u, h, parent, branch in edges if not (aimed and v == target) else ():
                    if (u, h) == (uuid, v) and parent not in best:
                        new[parent] = min(new.get(parent, (10**9, "")), (best[v][0] + 1, best[v][1] + str(branch)))
            best |= new
            level = list(new)
        out |= {(uuid, tag, target, v, *r) for v, r in best.items() if not (aimed and target in best) or v == target}
    return out


@pytest.mark.parametrize("block", [1 << 18, 256, 16])
def test_climbing_in_tasks_and_by_rounds(spark, monkeypatch, block):
    """Branches, merges, rings and unknown versions; histories of more rows than a task follows go by rounds."""
    rng = random.Random(5)
    edges = list({(f"u{u}", f"v{i}", f"v{j}"): (f"u{u}", f"v{i}", f"v{j}", b) for u in range(6) for i in range(9) for b in (0, 1) if (j := rng.randrange(9)) < 8 - u}.values())
    rows = sorted({(f"u{u}", f"t{i}", f"v{rng.randrange(10)}", f"v{rng.randrange(10)}") for u in range(7) for i in range(3)})
    monkeypatch.setattr(ancestry, "BLOCK", block)
    monkeypatch.setattr(ancestry, "REACH", 64)
    known = spark.createDataFrame(edges, "uuid string, hash string, parent string, branch int")
    for aimed in (False, True):
        names = ["uuid", "tag", "target" if aimed else "aim", "node"]
        got = lambda paths: [tuple(r) for r in ancestry.climb(spark.createDataFrame(rows, names), known, paths).select(*names, "depth", "path").collect()]  # noqa: B023, E731
        want = reached(rows, edges, aimed)
        one, two = got(True), got(False)
        assert sorted(one) == sorted(want) and sorted(two) == sorted((*r[:5], "") for r in want)


@pytest.mark.parametrize("size", [1, 2, 7])
def test_a_task_leaves_long_histories(size):
    """However rows come, those of a history stay together; starts of long ones come back once each."""
    key = lambda u, v: f"{u}/{v}".encode() if v else None
    rows = [(u, node, other, 0, own) for u, n in (("a", 3), ("b", 20), ("c", 2), ("d", 20), ("e", 4)) for node, other, own in [*((f"v{i}", f"v{i - 1}", None) for i in range(n, 0, -1)), (f"v{n}", None, {"tag": "x", "_start": True})]]
    table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("uuid", "node", "other", "way", "own"))} | {"a": [key(r[0], r[1]) for r in rows], "b": [key(r[0], r[2]) for r in rows]})
    got = [(r["uuid"], r["node"], r["depth"], r["long"]) for b in ancestry._climber(False, 10, 4, False)(iter(table.to_batches(size))) for r in b.to_pylist()]
    assert sorted(got) == sorted([*((u, f"v{n - i}", i, False) for u, n in (("a", 3), ("c", 2), ("e", 4)) for i in range(n + 1)), ("b", "v20", 0, True), ("d", "v20", 0, True)])


def test_short_histories_take_no_rounds(spark, tables, written):
    """What an answer needs: the questions and what is reached."""
    _, edges = history(spark)
    heads = spark.createDataFrame([(f"file-{f:05}", version(f, LONG - 1), version(f, LONG - 1)) for f in range(FILES)], "uuid string, start string, node string")
    assert ancestry.climb(heads, edges).count() == FILES * LONG
    assert tables == ["begin", "near"] and written() < 100
