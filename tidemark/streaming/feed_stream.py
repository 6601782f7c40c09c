"""A change feed as a stream with memory: each object's last path, size and time are state, keyed by its native id.

What a page tells is compared with what is known: echoes of what this side wrote, pages that are told twice and removals
of strangers give nothing. A removal waits for a while, as an object that was moved may be told as removed and then as
added. Where the feed has lost its place (a reset), ``baseline_rows`` turns a full listing into rows like any others, so
that state starts over from it without forgetting what it can still tell the difference to.

Sessions need spark.sql.streaming.stateStore.providerClass to name the RocksDB provider, as for all keyed state with timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.paths import in_control_dir
from ..schema import FEED

#: Rows of a page: those of the feed, and whether this side wrote the object itself.
PAGE = FEED + ", own boolean"
CHANGES = "native string, change string, path string, was_path string, size bigint, mtime bigint"
KNOWN = "path string, size bigint, mtime bigint"


class Tracker(StatefulProcessor):
    """Changes of one object at a time. ``grace`` is how many milliseconds a removal waits."""

    def __init__(self, grace: int) -> None:
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", KNOWN)
        self.leaving = handle.getValueState("leaving", "at bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[-1]
        self.known.update((row["path"], _whole(row["size"]), _whole(row["mtime"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told = pd.concat(list(rows)).sort_values(["page", "mtime"], kind="stable", na_position="first")
        before = now = self.known.get()
        gone = self.leaving.exists()
        for row in told.itertuples():
            if row.own and now is None and row.removed:
                continue
            if row.removed:
                if row.own:
                    before = now = None
                    gone = False
                elif now is not None:
                    gone = True
                continue
            path = row.path if isinstance(row.path, str) else now[0] if now is not None else None
            if path is None:
                continue  # no one knows where it is
            now, gone = (path, _whole(row.size), _whole(row.mtime)), False
            if row.own:
                before = now
        for timer in list(self.handle.listTimers()):
            if not gone:
                self.handle.deleteTimer(timer)
        if gone and not self.leaving.exists():
            at = timerValues.getCurrentProcessingTimeInMs() + self.grace
            self.leaving.update((at,))
            self.handle.registerTimer(at)
        elif not gone:
            self.leaving.clear()
        if now is None:
            self.known.clear()
        else:
            self.known.update(now)
        if now is not None and tuple(now) != (tuple(before) if before is not None else None):
            change = "created" if before is None else "moved" if now[0] != before[0] else "changed"
            yield _change(key, change, now, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        was = self.known.get()
        self.known.clear()
        self.leaving.clear()
        if was is not None:
            yield _change(key, "removed", was, was)


def _whole(value) -> int | None:
    return None if pd.isna(value) else int(value)


def _change(key: tuple, change: str, now: tuple, before: tuple | None) -> pd.DataFrame:
    row = {"native": key[0], "change": change, "path": now[0], "was_path": before[0] if before is not None else None, "size": now[1], "mtime": now[2]}
    return pd.DataFrame({c: pd.Series([v], dtype="Int64" if c in ("size", "mtime") else object) for c, v in row.items()})


def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of a folder, NDJSON files in order of their names, as a stream of their rows with ``page``."""
    rows = spark.readStream.schema(PAGE).option("pathGlobFilter", "*.ndjson").json(folder)
    none = F.lit(False)
    return rows.withColumns({"removed": F.coalesce("removed", none), "own": F.coalesce("own", none), "page": F.col("_metadata.file_name")})


def track_changes(pages: DataFrame, entries: DataFrame | None = None, grace_ms: int = 0) -> DataFrame:
    """CHANGES of a stream of pages: created, changed, moved or removed, each once, whatever runs again.

    ``entries`` (native, path, size, mtime) is what is known when the stream first starts; later starts go on from their
    checkpoint. Rows without a native id and those of the control folder are left out. As removals wait by the clock, the
    stream goes on looking when nothing comes: start it with trigger(processingTime=...), since one that is to end with
    what is available never ends.
    """
    asked = pages.filter(F.col("native").isNotNull() & ~F.coalesce(in_control_dir(F.col("path")), F.lit(False)))
    start = None
    if entries is not None:
        start = entries.filter("native is not null").select("native", "path", "size", "mtime").groupBy("native")
    return asked.groupBy("native").transformWithStateInPandas(Tracker(grace_ms), CHANGES, "Update", "ProcessingTime", start)


def baseline_rows(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a page that say what a full listing says: all that is there, and the removal of what is known and not there.

    listing and known are ``native, path, size, mtime``. Written as the next page after a reset, they bring the state to
    the listing; what is as it was gives no change.
    """
    seen = listing.filter("native is not null").select("native", "path", F.lit(False).alias("removed"), "size", "mtime")
    gone = known.filter("native is not null").join(seen.select("native"), "native", "left_anti")
    return seen.unionByName(gone.select("native", "path", F.lit(True).alias("removed"), "size", "mtime")).withColumn("own", F.lit(False))
