"""Two peers brought together: a plan of lazy DataFrames, and what holds once it is carried out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import entry_json, mergeable_digest, xor_digest
from ..operators.actions import count_transfers, needs_log, plan_actions
from ..operators.ancestry import location_edges, version_edges
from ..operators.lineage import Lineage
from ..operators.logset import append_rows, archives_since, latest, missing_rows, open_mark, union_rows, upsert_mark
from ..operators.merge import MergeOptions, coldest, entry_rows, merge_entries
from ..operators.snapshot import adopt
from ..operators.textmerge import merge_conflicts, settle_texts, text_rows
from ..schema import TEXT_EXTENSIONS
from .scratch import Scratch, keep, run


@dataclass
class PeerState:
    """What one peer holds: entries and log, its open segment, texts by hash, marks and snapshot.

    contents and bases are ``hash, text`` (bases also ``mtime``); marks ``peer, last_sync, segment, seq, digest``.
    """

    peer: str
    entries: DataFrame
    log: DataFrame
    segment: int = 0
    contents: DataFrame | None = None
    bases: DataFrame | None = None
    marks: DataFrame | None = None
    snapshot: DataFrame | None = None
    text: tuple[str, ...] = TEXT_EXTENSIONS
    store_id: str = ""
    #: The tables of entries, log and marks that a sync wrote for this state alone.
    tables: Scratch | None = None

    def release(self) -> None:
        """Remove this state's own tables, once a later state has taken its place. Contents stay: later states go on with them."""
        if self.tables is not None:
            self.tables.clear()

    def __post_init__(self) -> None:
        if "segment" not in self.log.columns:
            self.log = self.log.withColumn("segment", F.lit(self.segment).cast("bigint"))
        if "seq" not in self.log.columns:
            self.log = self.log.withColumn("seq", F.lit(0).cast("bigint"))

    def digest(self) -> str:
        """The mergeable digest of the live entries; state_digest gives the one that is exchanged."""
        live = self.entries.filter("not deleted").select(entry_json(*(F.col(c) for c in ("kind", "path", "hash", "size", "updated", "uuid"))).alias("j"))
        return live.agg(mergeable_digest(F.col("j")).alias("d")).first()["d"]

    def log_digest(self) -> str:
        return self.log.agg(xor_digest(F.col("op")).alias("d")).first()["d"]

    def peer_marks(self) -> DataFrame:
        return self.marks if self.marks is not None else self.entries.sparkSession.createDataFrame([], MARK)

    def texts(self, kind: str) -> DataFrame:
        own = getattr(self, kind)
        return own if own is not None else self.entries.sparkSession.createDataFrame([], TEXTS)


MARK = "peer string, last_sync bigint, segment bigint, seq bigint, digest string"
TEXTS = "hash string, text string, mtime bigint"


@dataclass
class SyncOptions:
    """merge: how entries merge; auto_merge: whether texts merge by lines; resolve_text: a pandas UDF (path, base, a, b) for
    those that do not; archives: whether closed segments are read where a version would lose its content; lineage: what is
    kept of all histories met so far, which answers what descends from what, also from segments that are not read, and grows."""

    merge: MergeOptions = field(default_factory=MergeOptions)
    auto_merge: bool = True
    resolve_text: Callable | None = None
    archives: bool = True
    lineage: Lineage | None = None


@dataclass
class SyncPlan:
    entries: DataFrame
    conflicts: DataFrame
    actions_a: DataFrame
    actions_b: DataFrame
    rows_for_a: DataFrame
    rows_for_b: DataFrame
    changed: bool
    merged: DataFrame | None = None
    text: tuple[str, ...] = TEXT_EXTENSIONS
    store_id: str = ""
    #: Whether digests alone showed that both sides hold the same.
    quiet: bool = False

    def transfers(self, a: PeerState, b: PeerState) -> tuple[DataFrame, DataFrame]:
        return count_transfers(self.entries, self.actions_a, a.entries, b.entries), count_transfers(self.entries, self.actions_b, b.entries, a.entries)

    def summary(self) -> DataFrame:
        """One row: actions on each side, conflicts and merged texts, and whether anything would change."""
        count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        merged = self.merged if self.merged is not None else self.conflicts.limit(0)
        parts = (count(self.actions_a, "actions_a"), count(self.actions_b, "actions_b"), count(self.conflicts, "conflicts"), count(merged, "merged"))
        return reduce(lambda x, y: x.crossJoin(y), parts).withColumn("changed", F.lit(self.changed))  # single rows


def _history(a: PeerState, b: PeerState, since: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows of the open segments, and with ``since`` of those closed ones that reach to it or beyond."""

    def of(p: PeerState) -> DataFrame:
        now = p.log.filter(F.col("segment") >= p.segment)
        return now if since is None else now.unionByName(archives_since(p.log.filter(F.col("segment") < p.segment), since).select(*now.columns))

    return of(a), of(b)


def _merge(a: PeerState, b: PeerState, history: tuple[DataFrame, DataFrame], options: MergeOptions, lineage: Lineage | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Target, conflicts, and the edges of what the histories know, or the lineage of the versions that differ."""
    logs = union_rows(*(h.drop("segment", "seq") for h in history))
    ea, eb = entry_rows(a.entries), entry_rows(b.entries)
    old = [entry_rows(p.snapshot) for p in (a, b) if p.snapshot is not None]
    edges = keep(version_edges(*old, ea, eb, logs), "edges")
    if lineage is not None:
        lineage.append(edges)
        other = lambda x, y: x.alias("x").join(y.alias("y"), F.expr("x.uuid = y.uuid and x.hash <=> y.hash"), "left_anti").select("uuid")
        edges = keep(lineage.versions(other(ea, eb).union(other(eb, ea))), "lineage")
    moves = location_edges(*old, ea, eb) if "prev_path" not in logs.columns else location_edges(*old, ea, eb, logs)
    known = lambda p, log: reduce(lambda x, y: x.union(y), (x.select("uuid") for x in (p.entries, log, p.snapshot) if x is not None))
    last = latest(logs, reduce(lambda x, y: x.unionByName(y), old)) if old else latest(logs)
    entries, conflicts = merge_entries(a.entries, b.entries, edges, moves, last, known(a, history[0]), known(b, history[1]), options)
    return keep(entries, "target"), keep(conflicts, "conflicts"), edges


def plan_sync(a: PeerState, b: PeerState, options: SyncOptions | None = None, at_ms: int = 0, batch: str = "sync") -> SyncPlan:
    """What a sync would do. Histories are read only where entries alone cannot answer, closed segments only where a version would lose its content.

    Two digests on each side show whether there is anything to do at all; if not, nothing is read further and no table is written.
    """
    options = options or SyncOptions()
    text, store_id = tuple(sorted({*a.text, *b.text})), min(a.store_id, b.store_id)
    same_config = (text, store_id) == (tuple(sorted(a.text)), a.store_id) == (tuple(sorted(b.text)), b.store_id)
    quiet = a.digest() == b.digest()
    if quiet and a.log_digest() == b.log_digest():
        nothing, acts, rows = conflicts_of(a.entries.limit(0)), plan_actions(entry_rows(a.entries.limit(0)), entry_rows(a.entries.limit(0)), a.peer), a.log.limit(0)
        return SyncPlan(entry_rows(a.entries), nothing, acts, acts, rows, rows, not same_config, None, text, store_id, quiet=True)
    none = (a.log.limit(0), b.log.limit(0))
    history = none if quiet or not needs_log(a.entries, b.entries).first()["needed"] else _history(a, b, None)
    merging = replace(options.merge, text=text)
    target, conflicts, edges = _merge(a, b, history, merging, options.lineage)
    since = coldest(conflicts).first()["since"] if options.archives else None
    closed = lambda p: p.log.filter((F.col("segment") < p.segment) & (F.col("at_ms") >= since))
    if since is not None and not closed(a).select("op").union(closed(b).select("op")).isEmpty():
        target, conflicts, edges = _merge(a, b, _history(a, b, since), merging, options.lineage)
    merged, rows = None, None
    known = a.contents is not None or b.contents is not None
    if known and (options.auto_merge or options.resolve_text is not None) and not conflicts.filter("is_text").isEmpty():
        contents = a.texts("contents").select("hash", "text").union(b.texts("contents").select("hash", "text"))
        bases = a.texts("bases").select("hash", "text").union(b.texts("bases").select("hash", "text"))
        found = merge_conflicts(conflicts, edges, contents, bases if options.auto_merge else bases.limit(0), at_ms, a.peer, options.resolve_text)
        merged = keep(found, "merged")
        if merged.isEmpty():
            merged = None
        else:
            rows = keep(text_rows(target, merged, batch), "text-rows")
            target = keep(settle_texts(target, merged), "target")
            conflicts = conflicts.join(merged.select("uuid", F.lit(True).alias("_merged")), "uuid", "left").withColumn("copy", F.when(F.col("_merged").isNull(), F.col("copy"))).drop("_merged")
    plus = lambda log: log if rows is None else log.unionByName(rows, allowMissingColumns=True)
    return SyncPlan(
        target, conflicts, plan_actions(entry_rows(a.entries), target, a.peer), plan_actions(entry_rows(b.entries), target, b.peer),
        missing_rows(a.log, plus(b.log)), missing_rows(b.log, plus(a.log)), True, merged, text, store_id)


def conflicts_of(none: DataFrame) -> DataFrame:
    """No conflicts, with the columns of conflicts."""
    return none.select(*(F.lit(None).cast(t).alias(c) for c, t in (
        ("uuid", "string"), ("kind", "string"), ("path", "string"), ("winner", "string"), ("is_text", "boolean"), ("copy", "string"),
        ("left_hash", "string"), ("right_hash", "string"), ("larger", "bigint"), ("newest", "bigint"), ("lost_at", "bigint"))))


def here(entries: DataFrame) -> DataFrame:
    """Hashes of the files whose bytes a side has: live ones that are not held on another peer."""
    full = entry_rows(entries)
    return full.filter("not deleted and kind = 'file' and hash is not null and held is null").select("hash").distinct()


def arriving(plan: SyncPlan, actions: DataFrame, to: PeerState, other: PeerState) -> DataFrame:
    """``hash, text, mtime`` that one side lacks for its planned writes: merged texts, else what the other side has. Nothing else moves.

    Planned writes leave out what is held elsewhere, so held bytes stay where they are.
    """
    wanted = actions.filter("type = 'write'").select("uuid").join(plan.entries.select("uuid", "hash"), "uuid").filter("hash is not null").select("hash").distinct()
    wanted = wanted.join(here(to.entries), "hash", "left_anti")
    source = other.texts("contents").join(here(other.entries), "hash", "left_semi").select("hash", "text")
    if plan.merged is not None:
        own = plan.merged.select("hash", "text")
        source = own.unionByName(source.join(own.select("hash"), "hash", "left_anti"))
    return source.join(wanted, "hash", "left_semi").dropDuplicates(["hash"]).select("hash", "text", F.lit(None).cast("bigint").alias("mtime"))


def close(a: PeerState, b: PeerState, at_ms: int) -> tuple[PeerState, PeerState]:
    """Both peers with marks of how far they have read each other's open segment."""
    spark = a.entries.sparkSession
    mark = lambda p, other: upsert_mark(p.peer_marks(), other.peer, at_ms, open_mark(other.log, other.segment))
    small = lambda marks: spark.createDataFrame(marks.collect(), MARK)  # noqa: E731  a row a peer that this one has met
    return replace(a, marks=small(mark(a, b))), replace(b, marks=small(mark(b, a)))


def sync(a: PeerState, b: PeerState, options: SyncOptions | None = None, approve: Callable[[SyncPlan], bool] | None = None, at_ms: int = 0, batch: str = "sync", on_conflicts: Callable[[DataFrame], None] | None = None) -> tuple[PeerState, PeerState, bool]:
    """Both peers afterwards, and whether anything changed; a refused plan changes nothing.

    Contents come first, then logs, then entries and marks: what is declared is never ahead of what is there. A side's
    contents are those that it had and what arrives, which is appended; what it has already is not read. Tables
    of the way there are removed; those of a state belong to it (``PeerState.release``). ``on_conflicts`` is given the
    conflicts of an approved plan while its tables are there.
    """
    if a.peer == b.peer:
        return a, b, False
    spark = a.entries.sparkSession
    with run(spark, "sync"):
        plan = plan_sync(a, b, options, at_ms, batch)
        if plan.quiet:
            return *close(replace(a, text=plan.text, store_id=plan.store_id), replace(b, text=plan.text, store_id=plan.store_id), at_ms), plan.changed
        if approve is not None and not approve(plan):
            return a, b, False
        if on_conflicts is not None:
            on_conflicts(plan.conflicts)
        known = a.contents is not None or b.contents is not None
        moved = [Scratch(spark, "contents").save(arriving(plan, acts, p, other), "arrived") if known else None for p, other, acts in ((a, b, plan.actions_a), (b, a, plan.actions_b))]

        def after(p: PeerState, rows: DataFrame, new: DataFrame | None) -> PeerState:
            tables = Scratch(spark, f"state-{p.peer}")
            log = tables.save(append_rows(p.log, rows, p.segment), "log")
            held = [c for c in ("native", "mtime") if c in p.entries.columns]
            entries = tables.save(adopt(plan.entries, p.entries) if len(held) == 2 else plan.entries, "entries")
            contents = p.contents if new is None else new.select("hash", "text") if p.contents is None else p.contents.select("hash", "text").unionByName(new.select("hash", "text"))
            return replace(p, entries=entries, log=log, contents=contents, text=plan.text, store_id=plan.store_id, tables=tables)

        return *close(after(a, plan.rows_for_a, moved[0]), after(b, plan.rows_for_b, moved[1]), at_ms), True
