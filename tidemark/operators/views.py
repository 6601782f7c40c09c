"""Read queries: rollups, comparison across peers, tracking state, pending conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, dirname, in_control_dir, sort_key
from ..schema import CONTROL_DIR


def live(entries: DataFrame) -> DataFrame:
    return entries.filter(~F.coalesce(F.col("deleted"), F.lit(False)))


def directory_rollup(files: DataFrame) -> DataFrame:
    """``dir, n, bytes`` of everything below each directory; sums combine before the shuffle."""
    return files.select(F.explode(ancestors(F.col("path"))).alias("dir"), "size").groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def child_counts(files: DataFrame) -> DataFrame:
    """Files and folders right below each directory, the control folder left out."""
    shown = files.filter(~in_control_dir(F.col("path")))
    leaves = shown.select(dirname(F.col("path")).alias("dir"), F.col("path").alias("child"))
    folders = shown.select(F.explode(ancestors(F.col("path"))).alias("child")).select(dirname(F.col("child")).alias("dir"), "child")
    return leaves.union(folders).distinct().groupBy("dir").agg(F.count(F.lit(1)).alias("n"))


def folder_tree(files: DataFrame) -> DataFrame:
    """``dir, n, is_store`` of every folder but the control folders: how many files and folders stand right below, and whether it has a store of its own."""
    stores = files.filter(F.endswith("path", F.lit(f"{CONTROL_DIR}/vfs.json"))).select(dirname(dirname(F.col("path"))).alias("dir"), F.lit(True).alias("_store")).distinct()
    shown = files.filter(~F.col("path").rlike(rf"(?:^|/){CONTROL_DIR.replace('.', '[.]')}(?:/|\z)"))
    folders = shown.select(F.explode(ancestors(F.col("path"))).alias("dir")).union(stores.filter("dir <> ''").select("dir")).distinct()
    counted = child_counts(shown).withColumnRenamed("n", "_n")
    return folders.join(counted, "dir", "left").join(stores, "dir", "left").select("dir", F.coalesce("_n", F.lit(0)).alias("n"), F.coalesce("_store", F.lit(False)).alias("is_store"))


def across(mine: DataFrame, other: DataFrame) -> DataFrame:
    """``path, state``: same, differs or missing on the other side, unknown where a hash is not known."""
    o = other.select("path", F.struct("hash").alias("o"))
    state = F.when(F.col("o").isNull(), "missing").when(F.col("hash").isNull() | F.col("o.hash").isNull(), "unknown").when(F.col("hash") == F.col("o.hash"), "same").otherwise("differs")
    return mine.join(o, "path", "left").select("path", state.alias("state"))


def compare_directories(mine: DataFrame, other: DataFrame) -> DataFrame:
    """``dir, n, other_n, state``: whether as many files stand below each directory on the other side."""
    o = directory_rollup(other).select("dir", F.col("n").alias("other_n"))
    state = F.when(F.col("other_n").isNull(), "missing").when(F.col("n") == F.col("other_n"), "same").otherwise("differs")
    return directory_rollup(mine).select("dir", "n").join(o, "dir", "left").withColumn("state", state)


def tracking_state(files: DataFrame, entries: DataFrame) -> DataFrame:
    """``path, state``: recorded, modified or untracked."""
    known = live(entries).select("path", F.struct("hash").alias("e"))
    state = F.when(F.col("e").isNull(), "untracked").when(F.col("hash").eqNullSafe(F.col("e.hash")), "recorded").otherwise("modified")
    return files.join(known, "path", "left").select("path", state.alias("state"))


def pending_conflicts(entries: DataFrame) -> DataFrame:
    """Live copies with the entry that they lost against, if it is there."""
    copies = live(entries).filter("conflict_of is not null").select(F.col("uuid").alias("copy"), F.col("path").alias("copy_path"), "reason", F.col("conflict_of").alias("uuid"))
    return copies.join(entries.select("uuid", "path", "deleted"), "uuid", "left").select("uuid", "path", "deleted", "copy", "copy_path", "reason")


def distinct_hashes(entries: DataFrame) -> DataFrame:
    held = F.col("held").isNull() if "held" in entries.columns else F.lit(True)
    return live(entries).filter((F.col("kind") == "file") & held & F.col("hash").isNotNull()).select("hash").distinct()


def tree_order(files: DataFrame) -> DataFrame:
    """Directories first, then by name, then by path."""
    return files.orderBy(F.col("kind") == "file", sort_key(F.substring_index("path", "/", -1)), sort_key(F.col("path")))
