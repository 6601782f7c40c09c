"""Renames as maps that compose: the same as one fold, however the list is split."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import snapshot


def fold(renames):
    now = {}
    for a, b in renames:
        first = now.pop(a, a)
        now.pop(b, None)
        now[b] = first
    return sorted((p, o) for p, o in now.items() if p != o)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_as_one_fold(spark, parts):
    rng, rows, wanted = random.Random(int(parts)), [], []
    for store in ("s", "t", "u"):
        names = [f"p{i}" for i in range(8 if store != "u" else 60)]
        own = [tuple(rng.sample(names, 2)) for _ in range(240)]
        rows += [(store, i, a, b) for i, (a, b) in enumerate(own)]
        wanted += [(store, *x) for x in fold(own)]
    swap = [("x", "tmp"), ("y", "x"), ("tmp", "y"), ("r", "q"), ("q", "r")]
    rows += [("v", i, a, b) for i, (a, b) in enumerate(swap)]
    wanted += [("v", "x", "y"), ("v", "y", "x")]
    table = spark.createDataFrame(rows, "store string, seq int, from_path string, to_path string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(tuple(r) for r in snapshot.collapse_renames(table).collect()) == sorted(wanted)
        assert snapshot.collapse_renames(table.limit(0)).collect() == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_long_list_of_one_store(spark):
    """A hundred thousand renames of one store: half of the files go round, half stay moved."""
    n = 25_000
    ids = spark.range(n)
    step = lambda i, a, b: ids.filter("id % 2 = 0" if i == 3 else "true").select(F.lit("s").alias("store"), (F.col("id") + i * n).alias("seq"), F.concat("id", F.lit(a)).alias("from_path"), F.concat("id", F.lit(b)).alias("to_path"))
    table = step(0, "a", "b").union(step(1, "b", "c")).union(step(2, "c", "d")).union(step(3, "d", "a"))
    out = snapshot.collapse_renames(table)
    assert out.count() == n // 2 and out.filter("path = replace(origin, 'a', 'd') and cast(replace(origin, 'a', '') as int) % 2 = 1").count() == n // 2
