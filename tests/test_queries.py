"""Queries against their SQL on the smallest tables, and peers that converge."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark import queries as core
from tidemark.operators import logset, merge
from tidemark.plans.mesh import chain, full, star, sync_until_stable
from tidemark.plans.sync import PeerState, plan_sync, sync
from tidemark.schema import ENTRIES, LOG

SF = "/root/testdata/sf0.001"
QUICK = ("live_entries", "state_digest_by_store", "op_ids", "log_xor_digest", "log_union", "latest_per_uuid", "cumulative_snapshot", "pair_fallback_path", "merge_entries", "plan_actions", "scan_changes", "dir_rollup", "change_feed_filter", "diff3_merge", "rotation_due")


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    df = core.QUERIES[name](spark, SF)
    result = con.execute(core.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.select(*names).collect()) == plain(result.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(core.QUERIES) <= set(entry.queries())


def test_topologies():
    assert chain(["a", "b", "c"]) == [("a", "b"), ("b", "c")] and star(["a", "b", "c"]) == [("a", "b"), ("a", "c")] and len(full(list("abcd"))) == 6


def peer(spark, name, rows):
    names = [x.strip().split(" ")[0] for x in ENTRIES.split(",")]
    full_rows = [{"kind": "file", "size": 1, "created": 1, "peer": name, "deleted": False} | r for r in rows]
    return PeerState(name, merge.entry_rows(spark.createDataFrame([tuple(r.get(n) for n in names) for r in full_rows], ENTRIES)), spark.createDataFrame([], LOG))


@pytest.mark.parametrize("seed", [1])
def test_random_peers_converge(spark, seed):
    rng = random.Random(seed)
    peers = {}
    for name in ("a", "b", "c"):
        rows = [{"uuid": f"u{i}", "path": f"f{rng.randrange(6)}.md" if rng.random() < 0.2 else f"f{i}.md", "hash": f"h{rng.randrange(3)}", "prev": "h0", "updated": rng.randrange(100)} for i in range(6) if rng.random() < 0.8]
        peers[name] = peer(spark, name, rows)
    peers, rounds = sync_until_stable(peers, chain(list(peers)))
    assert rounds[-1] == 0 and len({p.digest() for p in peers.values()}) == 1
    live = peers["a"].entries.filter("not deleted")
    assert live.count() == live.select("path").distinct().count()


def test_sync_either_way_gives_the_same(spark):
    a, b = peer(spark, "a", [{"uuid": "1", "path": "x", "hash": "p", "updated": 5}]), peer(spark, "b", [{"uuid": "1", "path": "x", "hash": "q", "updated": 5}, {"uuid": "2", "path": "y", "hash": "r", "updated": 1}])
    one, two = sync(a, b)[0], sync(b, a)[0]
    pick = lambda s: plain(s.entries.select("uuid", "path", "hash").collect())
    assert pick(one) == pick(two)
    assert sync(one, PeerState("b", one.entries, one.log))[2] is False and sync(a, a)[2] is False
    refused = sync(a, b, approve=lambda plan: False)
    assert refused[2] is False and refused[0] is a
    assert plan_sync(a, b).transfers(a, b)[0].first()["transfers"] == 2


def test_log_rotation(spark):
    rows = spark.createDataFrame([("o1", "1", 1, False), ("o2", "1", 2, True), ("o3", "2", 3, False)], "op string, uuid string, updated long, deleted boolean")
    first, second = rows.filter("op = 'o1'").drop("op"), rows.filter("op <> 'o1'").drop("op")
    assert plain(logset.cumulative_snapshot(first, second).collect()) == [("1", 2, True), ("2", 3, False)]
    log = spark.createDataFrame([("o", 5)], "op string, segment long")
    assert logset.should_rotate(log, 3).first()["rotate"] and not logset.should_rotate(log, 300).first()["rotate"]
    marks = spark.createDataFrame([], "peer string, last_sync long")
    deletes = spark.createDataFrame([("1", "delete")], "uuid string, type string")
    assert logset.prune_tombstones(second, deletes, marks).count() == 2
    marks = spark.createDataFrame([("p", 10)], "peer string, last_sync long")
    assert [r["uuid"] for r in logset.prune_tombstones(second, deletes, marks).select("uuid").collect()] == ["2"]
    assert rows.agg(F.count("*")).first()[0] == 3


def test_rotation_and_ids(spark):
    from tidemark.operators.rotation import id3_size, resolve_ids, root_snapshot, rotate

    log = spark.createDataFrame([("o1", 5), ("o2", 5)], "op string, segment long")
    now = spark.createDataFrame([("1", 7, True)], "uuid string, updated long, deleted boolean")
    before = spark.createDataFrame([("1", 3, False), ("2", 1, False)], "uuid string, updated long, deleted boolean")
    snap, segment = rotate(log, now, before, 5, 9, 10)
    assert segment == 9 and plain(snap.collect()) == [("1", 7, True), ("2", 1, False)]
    assert rotate(log, now, None, 5, 3, 10)[1] == 6 and rotate(log, now, before, 5, 9, 1000) == (before, 5)
    tree = spark.createDataFrame([("r", None, "a"), ("s", "r", "b"), ("t", "s", "c.txt")], "id string, parent string, name string")
    assert plain(resolve_ids(tree).collect()) == [("r", "a"), ("s", "a/b"), ("t", "a/b/c.txt")]
    deep = spark.createDataFrame([(str(i), str(i - 1) if i else None, "d") for i in range(150)] + [("lost", "nowhere", "x")], "id string, parent string, name string")
    assert plain(resolve_ids(deep).collect())[-1] == ("99", "/".join("d" * 100)) and resolve_ids(deep).count() == 150
    with pytest.raises(ValueError, match="cycle"):
        resolve_ids(spark.createDataFrame([("a", "b", "x"), ("b", "a", "y")], "id string, parent string, name string"))
    files = spark.createDataFrame([("x", 3)], "path string, size long")
    entries = spark.createDataFrame([(False, None), (True, None), (False, "1")], "deleted boolean, conflict_of string")
    assert tuple(root_snapshot(files, entries).first()) == (1, 3, 2, 1, 1)
    tags = spark.createDataFrame([(bytearray(b"ID3\x04\x00\x00\x00\x00\x02\x01rest"),), (bytearray(b"none"),)], "c binary")
    assert [r[0] for r in tags.select(id3_size(F.col("c"))).collect()] == [267, 0]
