"""A folder's changes taken into its peer's state: scanned, logged, rotated and pruned."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.actions import same_entries
from ..operators.logset import append_rows, kept_texts, prune_tombstones
from ..operators.rotation import rotate
from ..operators.snapshot import reuse_hashes, scan, stamp
from ..schema import BASE_CAP, MAX_TEXT_MERGE, ROTATE_AT
from .scratch import keep
from .sync import PeerState


def with_native(entries: DataFrame) -> DataFrame:
    """Entries with the columns that only their own node knows, null where it has not said."""
    kinds = {"native": "string", "mtime": "bigint"}
    return entries.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in entries.columns})


def hashed(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Files with their hash: the recorded one where size and time are unchanged, else that of ``content``."""
    if "hash" in files.columns:
        return files
    known = reuse_hashes(files, entries)
    return known.withColumn("hash", F.coalesce("hash", F.when(F.col("kind") == "file", F.sha2(F.col("content").cast("binary"), 256))))


def commit(state: PeerState, files: DataFrame, now_ms: int, batch: str, renames: DataFrame | None = None, rotate_at: int = ROTATE_AT, new_uuid=None) -> tuple[PeerState, str | None]:
    """The state after a look at its folder, and the batch, or null where nothing has moved and the log must not grow.

    ``files`` are path, kind, size, mtime, native and hash or content. The order is: texts kept, rows appended, the
    segment closed with its snapshot, and only then tombstones pruned, which the snapshot can still prove.
    """
    before = with_native(state.entries)
    at_ms = stamp(before, now_ms).first()["at_ms"]
    seen = hashed(files, before)
    entries, rows = scan(seen.select("path", "kind", "size", "mtime", "native", "hash"), before, state.peer, at_ms, renames, new_uuid)
    entries, rows = keep(entries, "scanned"), keep(rows.withColumn("batch", F.lit(batch)), "rows")
    if rows.isEmpty() and same_entries(state.entries, entries).first()["same"]:
        return state, None
    contents, bases = state.contents, state.bases
    if "content" in seen.columns:
        texts = seen.filter("hash is not null").select("hash", F.col("content").cast("string").alias("text"))
        contents = keep((texts if contents is None else texts.union(contents.select("hash", "text"))).dropDuplicates(["hash"]), "contents")
        bases = keep(kept_texts(entries, state.entries, texts, state.texts("bases"), state.text, MAX_TEXT_MERGE, BASE_CAP), "bases")
    log = keep(append_rows(state.log, rows, state.segment), "log")
    snapshot, segment = rotate(log, entries, state.snapshot, state.segment, now_ms, rotate_at)
    if segment != state.segment:
        snapshot = keep(snapshot, "snapshot")
    entries = keep(prune_tombstones(entries, log, state.peer_marks(), snapshot), "entries")
    return replace(state, entries=entries, log=log, contents=contents, bases=bases, snapshot=snapshot, segment=segment), batch
