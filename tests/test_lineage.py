"""Histories as runs answer as climbing version by version does, in one step where nothing branched."""

import random

from pyspark.sql import functions as F

from tidemark.operators import ancestry, lineage

EDGES = "uuid string, hash string, parent string, branch int"


def random_history(rng, uuid, n):
    """Versions by number, each from one or two before it; now and then a new beginning."""
    out = []
    for i in range(1, n):
        if rng.random() < 0.08:
            continue
        first = i - 1 if rng.random() < 0.7 else rng.randrange(max(0, i - 5), i)
        out.append((uuid, f"v{i:03}", f"v{first:03}", 0))
        if rng.random() < 0.2:
            out.append((uuid, f"v{i:03}", f"v{rng.randrange(i):03}", 1))
    return out


def plain(edges):
    up = {}
    for uuid, h, p, b in edges:
        up.setdefault((uuid, h), {}).setdefault(p, b)
        up[uuid, h][p] = min(b, up[uuid, h][p])

    def back(uuid, h):
        """Ancestors in the order of a search by breadth that looks at prev first."""
        met, level = {}, [h]
        while level:
            nxt = []
            for x in level:
                for p in sorted(up.get((uuid, x), {}), key=lambda q: up[uuid, x][q]):
                    if p not in met and p != h:
                        met[p] = len(met)
                        nxt.append(p)
            level = nxt
        return met

    return back


def test_questions(spark):
    rng = random.Random(5)
    edges = [e for u in range(12) for e in random_history(rng, f"u{u}", 45)] + [("ring", "x", "y", 0), ("ring", "y", "x", 0), ("ring", "z", "y", 0), ("u0", "self", "self", 0)]
    back = plain(edges)
    df = spark.createDataFrame(edges, EDGES)
    versions = lineage.runs(df)
    names = sorted({(e[0], x) for e in edges for x in e[1:3] if e[0] != "ring" and x != "self"})
    asked = [(u, a, rng.choice([y for v, y in names if v == u])) for u, a in names for _ in range(4)] + [("ring", "z", "x"), ("ring", "x", "z"), ("u0", "nobody", "v001"), ("nowhere", "a", "b")]
    asked = sorted(set(asked))
    pairs = spark.createDataFrame(asked, "uuid string, hash string, ancestor string").withColumns({"prev": F.lit(None).cast("string"), "prev2": F.lit(None).cast("string")})
    got = {tuple(r)[:3]: r["descends"] for r in lineage.descends(pairs, versions).select("uuid", "hash", "ancestor", "descends").collect()}
    assert got == {(u, h, a): h == a or a in back(u, h) for u, h, a in asked} and len(set(got.values())) == 2
    two = spark.createDataFrame(asked, "uuid string, left string, right string")
    bases = {(r["uuid"], r["left"], r["right"]): r["base"] for r in lineage.common_ancestor(two, versions).collect()}
    want = {}
    for u, a, b in asked:
        left, right = back(u, a), back(u, b)
        want[u, a, b] = min((x for x in left if x in right), key=left.get, default=None)
    assert {k: v for k, v in bases.items() if k[0] != "ring"} == {k: v for k, v in want.items() if k[0] != "ring"}
    assert {k: r["base"] for r in ancestry.common_ancestor(two, df).collect() if (k := (r["uuid"], r["left"], r["right"]))[0] != "ring"} == {k: v for k, v in want.items() if k[0] != "ring"}


def test_a_straight_history_is_one_run(spark):
    df = spark.createDataFrame([("u", f"{i}", f"{i - 1}", 0) for i in range(1, 700)], EDGES)
    versions = lineage.runs(df)
    assert versions.select("run").distinct().count() == 1 and {r["hash"]: r["place"] for r in versions.collect()} == {f"{i}": i for i in range(700)}
    assert lineage.links(versions).isEmpty()
    none = lineage.runs(df.limit(0))
    assert none.isEmpty() and lineage.common_ancestor(spark.createDataFrame([("u", "1", "2")], "uuid string, left string, right string"), none).first()["base"] is None


def test_odd_rows(spark):
    df = spark.createDataFrame([("u", "b", "a", 0), ("u", "b", "a", 1), ("u", "c", None, 0), ("u", None, "a", 0), (None, "b", "a", 0)], EDGES)
    versions = lineage.runs(df)
    assert sorted((r["hash"], r["place"], [p["branch"] for p in r["parents"]]) for r in versions.filter("uuid = 'u'").collect()) == [("a", 0, []), ("b", 1, [0])]
    pairs = spark.createDataFrame([("u", None, "a", "b", None), ("u", "b", None, None, None), ("u", "q", "a", None, "b")], "uuid string, hash string, ancestor string, prev string, prev2 string")
    assert [r["descends"] for r in lineage.descends(pairs, versions).sort("prev").collect()].count(True) == 2


def test_a_kept_lineage_grows(spark, tmp_path):
    rng = random.Random(8)
    edges = [e for u in range(6) for e in random_history(rng, f"u{u}", 40)]
    late = [(u, h, p, b) for u, h, p, b in edges if h >= "v030"]
    kept = lineage.Lineage(spark, str(tmp_path / "l"))
    pick = lambda t: sorted((r["uuid"], r["hash"], r["run"], r["place"], str(r["parents"])) for r in t.collect())
    assert kept.append(spark.createDataFrame([e for e in edges if e[1] < "v030"], EDGES)) > 0
    assert kept.append(spark.createDataFrame(late, EDGES)) > 0
    assert pick(kept.versions()) == pick(lineage.runs(spark.createDataFrame(edges, EDGES)))
    assert kept.append(spark.createDataFrame(late, EDGES)) == 0
    assert pick(kept.versions(spark.createDataFrame([("u3",)], "uuid string"))) == [r for r in pick(kept.versions()) if r[0] == "u3"]


def test_what_goes_on_from_the_newest_adds_its_own_rows_alone(spark, tmp_path):
    kept = lineage.Lineage(spark, str(tmp_path / "l"))
    kept.append(spark.createDataFrame([("u", f"{i}", f"{i - 1}", 0) for i in range(1, 50)] + [("w", "b", "a", 0), ("w", "c", "a", 0)], EDGES))
    assert kept.append(spark.createDataFrame([("u", "50", "49", 0), ("u", "51", "50", 0), ("w", "d", "b", 0), ("w", "d", "c", 1)], EDGES)) == 3
    at = {r["hash"]: (r["run"], r["place"]) for r in kept.versions().filter("uuid = 'u'").collect()}
    assert at["51"] == ("0", 51) and len(at) == 52
    assert kept.append(spark.createDataFrame([("u", "side", "20", 0)], EDGES)) == 53
    assert {r["place"] for r in kept.versions().filter("hash in ('21', 'side')").collect()} == {0}


def test_syncing_by_a_kept_lineage(spark, tmp_path):
    from test_sync import both, folder

    from tidemark.plans.commit import commit
    from tidemark.plans.sync import PeerState, SyncOptions, plan_sync

    a, b = both(spark)
    kept = lineage.Lineage(spark, str(tmp_path / "l"))
    # a is two versions on, which the lineage knows and no log says any more
    later, _ = commit(a, folder(spark, n_md="1\n"), 2000, "c1")
    later, _ = commit(later, folder(spark, n_md="2\n"), 2500, "c2")
    assert kept.append(ancestry.version_edges(later.log)) == 3
    bare, behind = PeerState("a", later.entries, later.log.limit(0)), PeerState("b", b.entries, b.log.limit(0))
    assert plan_sync(bare, behind, SyncOptions(lineage=kept)).conflicts.isEmpty()
    assert plan_sync(bare, behind).conflicts.count() == 1
    # where both sides changed, texts merge from the version that the lineage names
    b, _ = commit(b, folder(spark, n_md="one\ntwo\nTHREE\n"), 2500, "b3")
    a, _ = commit(a, folder(spark, n_md="ONE\ntwo\nthree\n"), 2000, "b2")
    plan = plan_sync(a, b, SyncOptions(lineage=kept), at_ms=3000)
    assert [r["text"] for r in plan.merged.collect()] == ["ONE\ntwo\nTHREE\n"] and kept.versions().count() == 5
