"""Syncing by itself: a stream of what changes, or of pages of a feed, is the clock."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def auto_sync(changes: DataFrame, step: Callable[[int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run ``step`` (a commit and a sync of the states that the caller holds) for each batch of a stream that has rows.

    One step ends before the next begins, and changes that come meanwhile are one batch. ``every`` (such as '1 minute') is how
    long to wait between looks; without it the stream ends once what is there is done. The checkpoint keeps what has been
    seen; a step that failed runs again, so it should find done what was done, as commits and syncs do.
    """

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            step(number)

    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()
