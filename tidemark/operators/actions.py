"""From a merged target to the actions that bring one side there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import sort_key


def plan_actions(current: DataFrame, target: DataFrame, me: str) -> DataFrame:
    """``uuid, type, kind, path, from_path, created``: one full outer join, each row giving at most two actions."""
    held = F.col("held") if "held" in target.columns else F.lit(None)
    t = target.select("uuid", F.struct("kind", "path", "hash", "deleted", held.alias("held")).alias("t"))
    c = current.select("uuid", F.struct("kind", "path", "hash", "deleted").alias("c"))
    x = c.join(t, "uuid", "full_outer")
    live = F.col("c").isNotNull() & ~F.coalesce(F.col("c.deleted"), F.lit(False))
    elsewhere = F.coalesce(F.col("t.held") != me, F.lit(False))
    wanted = F.col("t").isNotNull() & ~F.coalesce(F.col("t.deleted"), F.lit(False)) & ~elsewhere
    gone = live & (F.col("t").isNull() | F.coalesce(F.col("t.deleted"), F.lit(False)))

    def action(when, type_, kind, path, from_path=None, created=None):
        none = F.lit(None).cast("string")
        return F.when(when, F.struct(F.lit(type_).alias("type"), kind.alias("kind"), path.alias("path"), (from_path if from_path is not None else none).alias("from_path"), (created if created is not None else F.lit(False)).alias("created")))

    is_dir = F.col("t.kind") == "directory"
    steps = F.array(
        action(gone, "delete", F.col("c.kind"), F.col("c.path")),
        action(wanted & live & (F.col("c.path") != F.col("t.path")), "rename", F.col("t.kind"), F.col("t.path"), F.col("c.path")),
        action(wanted & is_dir & ~live, "mkdir", F.col("t.kind"), F.col("t.path")),
        action(wanted & ~is_dir & (~live | ~F.col("c.hash").eqNullSafe(F.col("t.hash"))), "write", F.lit("file"), F.col("t.path"), None, ~live),
    )
    return x.select("uuid", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s")).select("uuid", "s.*")


def sort_actions(actions: DataFrame) -> DataFrame:
    return actions.orderBy(sort_key(F.col("path")), "type", sort_key(F.col("uuid")))


def deepest_first(actions: DataFrame) -> DataFrame:
    """Deletes in an order in which a folder comes after all that it holds."""
    return actions.filter("type = 'delete'").orderBy(F.desc(F.length("path")), sort_key(F.col("path")))


def count_transfers(target: DataFrame, actions: DataFrame, current: DataFrame, remote: DataFrame) -> DataFrame:
    """Distinct contents that must come from the other side: written, not held here, held there."""
    held = lambda e: e.filter("not deleted and kind = 'file' and hash is not null").select("hash").distinct()
    writes = actions.filter("type = 'write'").select("uuid").join(target.select("uuid", "hash"), "uuid").select("hash").distinct()
    return writes.join(held(current), "hash", "left_anti").join(held(remote), "hash", "left_semi").agg(F.count(F.lit(1)).alias("transfers"))


def summarize(actions: DataFrame) -> DataFrame:
    """Counts by what a person would call it: changes, creates, deletes, renames."""
    what = F.when((F.col("type") == "write") & ~F.col("created"), "change").when(F.col("type").isin("write", "mkdir"), "create").otherwise(F.col("type"))
    return actions.groupBy(what.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def preview_groups(actions: DataFrame, conflicts: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """``category, n`` of all that a person would be asked to approve: what summarize counts, merged texts, and conflicts that stay."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("category"), "n")
    open_ = conflicts if merged is None else conflicts.join(merged.select("uuid"), "uuid", "left_anti")
    parts = summarize(actions).unionByName(count(open_, "conflict"))
    return (parts if merged is None else parts.unionByName(count(merged, "merge"))).filter("n > 0")


def needs_log(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether some uuid stands on one side alone or with another hash."""
    x = a.select("uuid", F.struct("hash").alias("a")).join(b.select("uuid", F.struct("hash").alias("b")), "uuid", "full_outer")
    differs = F.col("a").isNull() | F.col("b").isNull() | ~F.col("a.hash").eqNullSafe(F.col("b.hash"))
    return x.agg(F.coalesce(F.bool_or(differs), F.lit(False)).alias("needed"))


def same_entries(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both sides have the same uuids with equal path, hash, size and tombstone."""
    side = lambda x, n: x.select("uuid", F.struct("path", "hash", "size", "deleted").alias(n))
    x = side(a, "a").join(side(b, "b"), "uuid", "full_outer")
    return x.agg(F.coalesce(F.bool_and(F.col("a").eqNullSafe(F.col("b"))), F.lit(True)).alias("same"))
