"""Two peers' entries merged: content and location settled apart, losers kept as copies, paths made unique."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, conflict_name, extension
from ..plans.scratch import keep
from ..schema import HELD_AT, TEXT_EXTENSIONS
from .ancestry import moved_from
from .lineage import descends

ENTRY = ("kind", "path", "hash", "size", "created", "updated", "peer", "deleted", "prev", "prev2", "prev_path", "conflict_of", "reason", "base", "held")
TYPES = {"size": "bigint", "created": "bigint", "updated": "bigint", "deleted": "boolean"}


@dataclass
class MergeOptions:
    """copies: 'edits' (a copy where the winner has content), 'always' or 'never'; held_at: size from which a copy's bytes stay put;
    conflict_name: a copy's path from that of the entry, the loser's peer and its hash."""

    copies: str = "edits"
    held_at: int = HELD_AT
    text: tuple[str, ...] = TEXT_EXTENSIONS
    conflict_name: Callable[[Column, Column, Column], Column] = conflict_name


def entry_rows(entries: DataFrame) -> DataFrame:
    """Entries with all columns of an entry, missing ones null."""
    have = set(entries.columns)
    full = {c: (F.col(c) if c in have else F.lit(None)).cast(TYPES.get(c, "string")).alias(c) for c in ENTRY}
    full["deleted"] = F.coalesce(full["deleted"], F.lit(False)).alias("deleted")
    return entries.select("uuid", *full.values())


def _tie(side: str) -> Column:
    return F.concat_ws("|", F.coalesce(F.col(f"{side}.hash"), F.lit("")), F.col(f"{side}.peer"), F.col("uuid"))


def left_is_newer(left: str = "a", right: str = "b") -> Column:
    """Of two structs, whether the left one is picked: later, else the larger hash|peer|uuid, else left."""
    l, r = F.col(f"{left}.updated"), F.col(f"{right}.updated")
    return (l > r) | ((l == r) & (_tie(left) >= _tie(right)))


def pair_by_uuid(a: DataFrame, b: DataFrame) -> DataFrame:
    """``uuid, a, b``: a full outer join, a side that has no row being null."""
    side = lambda x, name: entry_rows(x).select("uuid", F.struct(*ENTRY).alias(name))
    return side(a, "a").join(side(b, "b"), "uuid", "full_outer")


def pair_by_path(pairs: DataFrame, known_a: DataFrame, known_b: DataFrame) -> DataFrame:
    """Rows of ``pairs`` that live on one side alone, under uuids that the other side never heard of, paired by kind and path.

    known_a and known_b hold the uuids that each side has met. The pair has the smaller uuid. At most one row a side
    and path takes part: the smallest uuid of a, the largest of b.
    """
    pairs = keep(pairs, "by-uuid")  # read six times
    both = pairs.filter("a is not null and b is not null")
    only_a, only_b = pairs.filter("b is null"), pairs.filter("a is null")
    loose_a = only_a.filter(~F.col("a.deleted")).join(known_b.select("uuid").distinct(), "uuid", "left_anti")
    loose_b = only_b.filter(~F.col("b.deleted")).join(known_a.select("uuid").distinct(), "uuid", "left_anti")
    one_a = loose_a.groupBy(F.col("a.kind").alias("kind"), F.col("a.path").alias("path")).agg(F.min("uuid").alias("ua"))
    one_b = loose_b.groupBy(F.col("b.kind").alias("kind"), F.col("b.path").alias("path")).agg(F.max("uuid").alias("ub"))
    met = one_a.join(one_b, ["kind", "path"]).select("ua", "ub")
    found = (
        met.join(only_a.select(F.col("uuid").alias("ua"), "a"), "ua").join(only_b.select(F.col("uuid").alias("ub"), "b"), "ub")
        .select(F.least("ua", "ub").alias("uuid"), "a", "b")
    )
    used = met.select(F.col("ua").alias("uuid")).union(met.select("ub"))
    rest = only_a.unionByName(only_b).join(used, "uuid", "left_anti")
    return both.unionByName(found).unionByName(rest)


def solo_rows(pairs: DataFrame, last: DataFrame) -> DataFrame:
    """One-sided rows; a live one whose uuid was deleted later elsewhere becomes a tombstone."""
    one = pairs.filter("a is null or b is null").select("uuid", F.coalesce("a", "b").alias("e")).select("uuid", *(F.col(f"e.{c}") for c in ENTRY))
    joined = one.join(last.select("uuid", "last_ms", "last_deleted"), "uuid", "left")
    gone = F.coalesce(F.col("last_deleted") & (F.col("last_ms") > F.col("updated")) & ~F.col("deleted"), F.lit(False))
    return joined.select(
        "uuid", *(F.col(c) for c in ("kind", "path")), F.when(~gone, F.col("hash")).alias("hash"), F.when(gone, 0).otherwise(F.col("size")).cast("bigint").alias("size"), "created",
        F.when(gone, F.col("last_ms")).otherwise(F.col("updated")).alias("updated"), "peer", (F.col("deleted") | gone).alias("deleted"),
        F.when(gone, F.col("hash")).otherwise(F.col("prev")).alias("prev"), *(F.col(c) for c in ENTRY[9:]))


def settle(pairs: DataFrame, edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Two-sided rows with ``side`` (whose content), ``conflict`` (kind or null), ``new_path`` and ``from_path``.

    Only rows that neither equal content nor the versions' own parents settle are looked up in the history.
    """
    same = F.col("a.hash").eqNullSafe(F.col("b.hash")) & (F.col("a.deleted") == F.col("b.deleted"))
    both = pairs.filter("a is not null and b is not null").withColumns({"newer": left_is_newer(), "same": same})
    open_ = both.filter(~F.col("same"))
    ask = lambda of, to: open_.select("uuid", F.lit(of).alias("of"), *(F.col(f"{of}.{c}").alias(c) for c in ("hash", "prev", "prev2")), F.col(f"{to}.hash").alias("ancestor"))
    apart = both.filter(F.col("a.path") != F.col("b.path"))
    go = lambda of, to: apart.select("uuid", F.lit(of).alias("of"), F.col(f"{of}.path").alias("path"), F.col(f"{of}.prev_path").alias("seed"), F.col(f"{to}.path").alias("target"))
    # both directions are asked at once
    down = descends(ask("a", "b").unionByName(ask("b", "a")), edges).select("uuid", "of", F.col("descends").alias("is"))
    moved = moved_from(go("a", "b").unionByName(go("b", "a")), moves).select("uuid", "of", F.col("moved").alias("is"))
    split = lambda found, name: found.groupBy("uuid").agg(*(F.bool_or(F.col("is") & (F.col("of") == of)).alias(f"{of}_{name}") for of in ("a", "b")))
    x = both
    for answer in (split(down, "down"), split(moved, "moved")):
        x = x.join(answer, "uuid", "left")
    x = x.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("a_down", "b_down", "a_moved", "b_moved")})
    newer = F.when(F.col("newer"), "a").otherwise("b")
    winner_down = F.when(F.col("newer"), F.col("a_down")).otherwise(F.col("b_down"))
    loser_down = F.when(F.col("newer"), F.col("b_down")).otherwise(F.col("a_down"))
    side = F.when(F.col("same") | winner_down | ~loser_down, newer).otherwise(F.when(F.col("newer"), "b").otherwise("a"))
    clash = ~F.col("same") & ~winner_down & ~loser_down
    content_kind = F.when(clash, F.when(F.col("a.deleted") | F.col("b.deleted"), "delete-edit").otherwise("content"))
    x = x.withColumns({"side": side, "_clash": content_kind})
    by_side = lambda field, pick: F.when(pick == "a", F.col(f"a.{field}")).otherwise(F.col(f"b.{field}"))
    equal = F.col("a.path") == F.col("b.path")
    one_moved = F.col("a_moved") != F.col("b_moved")
    mover = F.when(equal, F.col("side")).when(one_moved, F.when(F.col("a_moved"), "a").otherwise("b")).otherwise(newer)
    location = F.when(~equal & ~one_moved, "location")
    # a mover that does not say where it came from came from where the other side has the file
    from_path = F.coalesce(by_side("prev_path", mover), F.when(~equal, F.when(mover == "a", F.col("b.path")).otherwise(F.col("a.path"))))
    return x.select("uuid", "a", "b", "side", F.coalesce("_clash", location).alias("conflict"), by_side("path", mover).alias("new_path"), from_path.alias("from_path"))


def merged_rows(settled: DataFrame) -> DataFrame:
    x = settled.select("*", F.when(F.col("side") == "a", F.col("a")).otherwise(F.col("b")).alias("e"))
    from_path = F.when((F.col("from_path") != F.col("new_path")) & ~F.col("e.deleted"), F.col("from_path"))
    return x.select("uuid", F.col("e.kind").alias("kind"), F.col("new_path").alias("path"), *(F.col(f"e.{c}") for c in ("hash", "size")), F.least("a.created", "b.created").alias("created"), *(F.col(f"e.{c}") for c in ENTRY[5:10]), from_path.alias("prev_path"), *(F.col(f"e.{c}") for c in ENTRY[11:]))


def conflict_rows(settled: DataFrame, options: MergeOptions) -> DataFrame:
    """``uuid, kind, path, winner, is_text, copy`` of each conflict, both hashes and sizes, and times; copy is the kept copy's uuid or null."""
    lost = F.when(F.col("side") == "a", F.col("b")).otherwise(F.col("a"))
    x = settled.filter("conflict is not null").withColumn("lost", lost).withColumn("won", F.when(F.col("side") == "a", F.col("a")).otherwise(F.col("b")))
    at_risk = (F.col("conflict") != "location") & F.col("lost.hash").isNotNull()
    kept = {"always": at_risk, "edits": at_risk & F.col("won.hash").isNotNull()}.get(options.copies, F.lit(False))
    text = (F.col("conflict") == "content") & extension(F.col("new_path")).isin(*options.text) & F.col("a.hash").isNotNull() & F.col("b.hash").isNotNull()
    return x.select(
        "uuid", F.col("conflict").alias("kind"), F.col("new_path").alias("path"), F.col("side").alias("winner"), text.alias("is_text"),
        F.when(kept, F.concat(F.lit("conflict:"), F.col("uuid"), F.lit(":"), F.col("lost.hash"))).alias("copy"),
        F.col("a.hash").alias("left_hash"), F.col("b.hash").alias("right_hash"), F.greatest("a.size", "b.size").alias("larger"), F.greatest("a.updated", "b.updated").alias("newest"), F.col("lost.updated").alias("lost_at"), "lost")


def copy_rows(conflicts: DataFrame, options: MergeOptions) -> DataFrame:
    """The losers that are kept, as entries of their own."""
    x = conflicts.filter("copy is not null")
    reason = F.when(F.col("kind") == "delete-edit", "delete-edit").when(F.col("kind") == "kind", "kind").otherwise("binary")
    none = F.lit(None).cast("string")
    return x.select(
        F.col("copy").alias("uuid"), F.col("lost.kind").alias("kind"), options.conflict_name(F.col("path"), F.col("lost.peer"), F.col("lost.hash")).alias("path"), F.col("lost.hash").alias("hash"),
        F.col("lost.size").alias("size"), F.col("lost.updated").alias("created"), F.col("lost.updated").alias("updated"), F.col("lost.peer").alias("peer"), F.lit(False).alias("deleted"),
        none.alias("prev"), none.alias("prev2"), none.alias("prev_path"), F.col("uuid").alias("conflict_of"), reason.alias("reason"), F.col("lost.prev").alias("base"),
        F.when(F.col("lost.size") >= options.held_at, F.col("lost.peer")).alias("held"))


def resolve_collisions(entries: DataFrame, options: MergeOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """One live entry a path: the newest keeps it, others move aside; and a report ``uuid, kind, path, winner, is_text, copy`` of each loser.

    A directory that loses its path takes what is under it along, losers of other paths included; of several such
    directories above an entry the outermost does, as its move leaves nothing where the inner ones stood. They are found
    by a join on the entry's ancestors, not by comparing prefixes.
    """
    name = (options or MergeOptions()).conflict_name
    order = Window.partitionBy("path", "deleted").orderBy(F.desc("updated"), F.desc(F.concat_ws("|", F.coalesce("hash", F.lit("")), "peer", "uuid")))
    ranked = entries.withColumns({"_place": F.when(~F.col("deleted"), F.row_number().over(order)).otherwise(1), "_keeper": F.first(F.struct("uuid", "kind")).over(order)})
    lost = F.col("_place") > 1
    aside = name(F.col("path"), F.col("peer"), F.coalesce("hash", "uuid"))
    same = F.col("_keeper.kind") == F.col("kind")
    moved = ranked.withColumns({
        "_to": F.when(lost, aside),
        "conflict_of": F.when(lost, F.coalesce("conflict_of", F.col("_keeper.uuid"))).otherwise(F.col("conflict_of")),
        "reason": F.when(lost, F.coalesce("reason", F.when(same, "binary").otherwise("kind"))).otherwise(F.col("reason"))})
    moved = keep(moved, "collisions")  # read three times
    dirs = moved.filter(lost & (F.col("kind") == "directory")).groupBy(F.col("path").alias("dir")).agg(F.min_by("_to", "_place").alias("dir_to"))
    above = moved.select("uuid", F.explode(ancestors(F.col("path"))).alias("dir")).join(dirs, "dir")
    under = above.groupBy("uuid").agg(F.min_by(F.struct("dir", "dir_to"), F.length("dir")).alias("d")).select("uuid", "d.dir", "d.dir_to")
    out = moved.join(under, "uuid", "left").withColumn("_at", F.coalesce("_to", "path"))
    path = F.when(F.col("dir").isNotNull(), F.concat(F.col("dir_to"), F.expr("substring(_at, length(dir) + 1)"))).otherwise(F.col("_at"))
    prev_path = F.when(F.col("dir").isNotNull(), F.col("_at")).when(lost, F.col("path")).otherwise(F.col("prev_path"))
    reports = moved.filter(lost).select(
        "uuid", F.when(same, "content").otherwise("kind").alias("kind"), "path", F.lit("a").alias("winner"), F.lit(False).alias("is_text"), F.col("uuid").alias("copy"))
    return out.select("uuid", "kind", path.alias("path"), *ENTRY[2:10], prev_path.alias("prev_path"), *ENTRY[11:]), reports


def merge_entries(a: DataFrame, b: DataFrame, edges: DataFrame, moves: DataFrame, last: DataFrame, known_a: DataFrame, known_b: DataFrame, options: MergeOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """Merged entries and conflicts of two peers, of content and place as well as of paths that several entries claim.

    edges (or versions with their runs, as ``lineage`` has them), moves and last come from the history of both sides; known_a and known_b are the uuids that each side has met.
    """
    options = options or MergeOptions()
    # pairs are read eight times, what is settled three times: each is worked out once
    pairs = keep(pair_by_path(pair_by_uuid(a, b), known_a, known_b), "pairs")
    settled = keep(settle(pairs, edges, moves), "settled")
    conflicts = conflict_rows(settled, options)
    entries = merged_rows(settled).unionByName(solo_rows(pairs, last))
    copies = copy_rows(conflicts, options).join(entries.select("uuid"), "uuid", "left_anti")
    apart, reports = resolve_collisions(entries.unionByName(copies), options)
    return apart, conflicts.drop("lost").unionByName(reports, allowMissingColumns=True)


def coldest(conflicts: DataFrame) -> DataFrame:
    """One row: the time of the oldest version that lost its content, or null where no archive could help."""
    return conflicts.filter(F.col("kind").isin("content", "delete-edit")).agg(F.min("lost_at").alias("since"))


def converge_config(headers: DataFrame) -> DataFrame:
    """The smaller store id and the sorted union of the text extensions."""
    return headers.agg(F.min("store_id").alias("store_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("text")))).alias("text"))
