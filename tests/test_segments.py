"""Logs by segment: reads open the partitions that they need."""

from pyspark.sql import functions as F

from tidemark.operators import logset
from tidemark.sources.segments import SegmentedLog


def rows(spark, store, segment, *at):
    import hashlib

    full = [(store, segment, hashlib.sha256(f"{store}{t}".encode()).hexdigest(), t, t // 10) for t in at]
    return spark.createDataFrame(full, "store string, segment long, op string, at_ms long, seq long")


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_segments(spark, tmp_path):
    log = SegmentedLog(spark, str(tmp_path))
    assert log.rows().collect() == [] and log.facts().collect() == [] and log.since(0).collect() == []
    for s in ("a", "b"):
        for g in (0, 100, 200):
            log.append(rows(spark, s, g, g + 1, g + 15))
    log.append(rows(spark, "a", 200, 250))
    facts = {(r["store"], r["segment"]): (r["rows"], r["min_at"], r["max_at"], r["last_seq"], r["digest"]) for r in log.facts().collect()}
    whole = log.rows().groupBy("store", "segment").agg(F.count("*").alias("n"), logset.xor_digest(F.col("op")).alias("d")).collect()
    assert {k: (v[0], v[4]) for k, v in facts.items()} == {(r["store"], r["segment"]): (r["n"], r["d"]) for r in whole}
    assert facts["a", 200][:4] == (3, 201, 250, 25) and len(facts) == 6
    found = log.since(116)
    assert sorted((r["store"], r["at_ms"]) for r in found.collect()) == [("a", 201), ("a", 215), ("a", 250), ("b", 201), ("b", 215)]
    assert sorted(map(tuple, found.select("op").collect())) == sorted(map(tuple, logset.archives_since(log.rows(), 116).select("op").collect()))
    assert "dynamicpruning" in plan(log.since(116))
    tail = log.open_rows("a", 200, (200, 20))
    assert [r["at_ms"] for r in tail.orderBy("at_ms").collect()] == [215, 250] and "PartitionFilters: [isnotnull(store" in plan(tail)
    assert log.open_rows("a", 200, (100, 20)).count() == 3 and len(tail.inputFiles()) >= 1
