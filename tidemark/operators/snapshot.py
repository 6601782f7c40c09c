"""What changed in a folder since the last look: files found now against entries known before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import op_id
from ..plans.scratch import keep


def stamp(entries: DataFrame, now_ms: int) -> DataFrame:
    """One row: the later of now and one after the latest update."""
    return entries.agg(F.greatest(F.lit(now_ms).cast("bigint"), F.coalesce(F.max("updated") + 1, F.lit(0))).alias("at_ms"))


#: What a run of renames does to a path that it touches: whether a file stands there at the end, which path that file had
#: at the run's beginning, and whether the run had left that path alone until then, so that earlier runs say where it came from.
RUN = "store string, part int, path string, there boolean, was string, through boolean"


def _fold_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Folds a partition's renames, sorted by store and seq, to a run for each store."""
    store, part, there, touched = None, 0, {}, {}

    def rows() -> pd.DataFrame:
        held = [(store, part, p, p in there, *there.get(p, (None, False))) for p in touched]
        return pd.DataFrame(held, columns=["store", "part", "path", "there", "was", "through"])

    for batch in batches:
        for r in batch.itertuples(index=False):
            if r.store != store:
                if touched:
                    yield rows()
                store, part, there, touched = r.store, r.part, {}, {}
            first = there[r.from_path] if r.from_path in there else (r.from_path, r.from_path not in touched)
            for p in (r.from_path, r.to_path):
                there.pop(p, None)
                touched[p] = True
            there[r.to_path] = first
    if touched:
        yield rows()


def _compose(runs: DataFrame) -> DataFrame:
    """Neighbouring runs of a store, the even and the odd one, as one."""
    pair = runs.withColumn("pair", F.shiftright("part", 1))
    late, early = pair.filter("part % 2 = 1"), pair.filter("part % 2 = 0")
    before = early.select("store", "pair", F.col("path").alias("was"), F.struct("there", F.col("was").alias("was"), "through").alias("e"))
    x = late.select("store", "pair", "path", "there", "was", "through").join(before, ["store", "pair", "was"], "left")
    asked = F.col("there") & F.col("through") & F.col("e").isNotNull()
    later = x.select(
        "store", F.col("pair").alias("part"), "path", "there", F.when(asked & F.col("e.there"), F.col("e.was")).otherwise(F.col("was")).alias("was"),
        F.when(asked, F.col("e.there") & F.col("e.through")).otherwise(F.col("through")).alias("through"))
    kept = early.join(late.select("store", "pair", "path"), ["store", "pair", "path"], "left_anti")
    return later.unionByName(kept.select("store", F.col("pair").alias("part"), "path", "there", "was", "through"))


def collapse_renames(renames: DataFrame) -> DataFrame:
    """``path, origin`` of recorded renames in order of seq: chains lead to their first path, round trips cancel out.

    What a run of renames does is a partial map, and maps of neighbouring runs compose: partitions of the sorted list are
    folded apart, and log2 of their number rounds of joins make them one, so a store's list may be of any length.
    """
    order = ["store", "seq", "from_path", "to_path"]
    placed = renames.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    runs = keep(placed.mapInPandas(_fold_runs, RUN), "runs")
    last = runs.agg(F.max("part")).first()[0] or 0
    while last > 0:
        runs, last = keep(_compose(runs), "runs"), last >> 1
    return runs.filter("there and path <> was").select("store", "path", F.col("was").alias("origin"))


def scan(files: DataFrame, entries: DataFrame, peer: str, at_ms: int, renames: DataFrame | None = None, new_uuid=None) -> tuple[DataFrame, DataFrame]:
    """New entries and log rows from ``files`` (path, kind, size, mtime, hash, native) and known ``entries``.

    A file is known, in this order, by its native id, a recorded rename, its path unless that moved away, or a
    vanished entry of equal hash (the k-th new path takes the k-th vanished one). Of two files with one
    identity the first by path keeps it; the other is new. ``new_uuid`` makes a uuid from path; by default a
    hash of peer, path and time.
    """
    make = new_uuid or (lambda path: F.sha2(F.concat_ws("|", F.lit(peer), path, F.lit(at_ms)), 256))
    known = entries.filter("not deleted").select(F.col("uuid").alias("u"), F.col("path").alias("was"), F.col("hash").alias("h"), F.col("native").alias("nat"))
    moves = collapse_renames(renames).select(F.col("path").alias("path"), "origin") if renames is not None else None
    seen = files
    if moves is None:
        seen = seen.withColumn("origin", F.lit(None).cast("string"))
        away = known.select("was").limit(0)
    else:
        seen = seen.join(moves, "path", "left")
        away = moves.select(F.col("origin").alias("was")).distinct()
    by_native = known.filter("nat is not null").select(F.col("nat").alias("native"), F.col("u").alias("u1"))
    by_origin = known.select(F.col("was").alias("origin"), F.col("u").alias("u2"))
    by_path = known.join(away, "was", "left_anti").select(F.col("was").alias("path"), F.col("u").alias("u3"))
    x = seen.join(by_native, "native", "left").join(by_origin, "origin", "left").join(by_path, "path", "left")
    x = x.withColumn("claim", F.coalesce("u1", "u2", "u3"))
    vanished = known.join(files.select(F.col("path").alias("was")), "was", "left_anti").join(x.select(F.col("claim").alias("u")), "u", "left_anti")
    turn = lambda key, by: F.row_number().over(Window.partitionBy(key).orderBy(by))
    free = vanished.filter("h is not null").withColumn("turn", turn("h", "was")).select(F.col("h").alias("hash"), "turn", F.col("u").alias("u4"))
    new = x.filter("claim is null and hash is not null").withColumn("turn", turn("hash", "path")).select("path", "hash", "turn")
    taken = new.join(free, ["hash", "turn"]).select("path", "u4")
    x = x.join(taken, "path", "left").withColumn("claim", F.coalesce("claim", "u4"))
    place = F.row_number().over(Window.partitionBy("claim").orderBy("path"))
    x = x.withColumn("_fresh", F.col("claim").isNull() | (place > 1)).withColumn("uuid", F.when(F.col("_fresh"), make(F.col("path"))).otherwise(F.col("claim")))
    prior = entries.select("uuid", F.struct(*[c for c in entries.columns if c != "uuid"]).alias("p"))
    y = x.drop("origin", "u1", "u2", "u3", "u4", "claim", "_fresh").join(prior, "uuid", "left")
    known_before = F.col("p").isNotNull()
    moved = known_before & (F.col("p.path") != F.col("path"))
    changed = ~known_before | ~F.col("p.hash").eqNullSafe(F.col("hash")) | (F.col("p.kind") != F.col("kind")) | F.coalesce(F.col("p.deleted"), F.lit(False))
    y = y.withColumns({"moved": F.coalesce(moved, F.lit(False)), "changed": F.coalesce(changed, F.lit(True))})
    bumped = F.col("moved") | F.col("changed")
    carried = lambda c: F.when(~F.col("changed"), F.col(f"p.{c}"))
    live = y.select(
        "uuid", "kind", "path", "hash", "size", F.coalesce("p.created", F.lit(at_ms)).alias("created"), F.when(bumped, F.lit(at_ms)).otherwise(F.col("p.updated")).alias("updated"),
        F.when(bumped, F.lit(peer)).otherwise(F.col("p.peer")).alias("peer"), F.lit(False).alias("deleted"), F.when(F.col("changed"), F.col("p.hash")).otherwise(F.col("p.prev")).alias("prev"),
        carried("prev2").alias("prev2"), F.when(F.col("moved"), F.col("p.path")).otherwise(F.col("p.prev_path")).alias("prev_path"), "native", "mtime",
        carried("conflict_of").alias("conflict_of"), carried("reason").alias("reason"), F.when(F.col("changed"), "write").when(F.col("moved"), "rename").alias("type"))
    gone = entries.join(live.select("uuid"), "uuid", "left_anti")
    fresh = ~F.col("deleted")
    tombs = gone.select(
        "uuid", "kind", "path", F.lit(None).cast("string").alias("hash"), F.lit(0).cast("bigint").alias("size"), "created", F.when(fresh, F.lit(at_ms)).otherwise(F.col("updated")).alias("updated"),
        F.when(fresh, F.lit(peer)).otherwise(F.col("peer")).alias("peer"), F.lit(True).alias("deleted"), F.when(fresh, F.col("hash")).otherwise(F.col("prev")).alias("prev"), "prev2", "prev_path",
        "native", "mtime", "conflict_of", "reason", F.when(fresh, "delete").alias("type"))
    every = live.unionByName(tombs)
    rows = every.filter("type is not null").select(
        op_id(F.lit(peer), F.col("uuid"), F.lit(at_ms), F.col("type"), F.col("path"), F.col("hash")).alias("op"), F.lit(at_ms).alias("at_ms"), F.lit(peer).alias("peer"),
        "uuid", "type", "kind", "path", "hash", "size", "prev", "prev2", "prev_path")
    return every.drop("type"), rows


def reuse_hashes(files: DataFrame, entries: DataFrame) -> DataFrame:
    """``files`` with the recorded hash where size and mtime are unchanged, else null: only those need their content read."""
    was = entries.filter("not deleted and hash is not null").select("path", F.col("hash").alias("_hash"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime").eqNullSafe(F.col("_mtime"))
    return files.join(was, "path", "left").withColumn("hash", F.when(same, F.col("_hash"))).drop("_hash", "_size", "_mtime")


def adopt(target: DataFrame, current: DataFrame) -> DataFrame:
    """The target as this side's entries: native and mtime stay where path and hash are as before."""
    mine = current.select("uuid", F.struct("path", "hash", "native", "mtime").alias("c"))
    x = target.drop("native", "mtime").join(mine, "uuid", "left")
    same = (F.col("c.path") == F.col("path")) & F.col("c.hash").eqNullSafe(F.col("hash"))
    return x.withColumns({"native": F.when(same, F.col("c.native")), "mtime": F.when(same, F.col("c.mtime"))}).drop("c")
