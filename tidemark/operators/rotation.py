"""Closing log segments, and what a store shows of itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import keep
from .logset import cumulative_snapshot, should_rotate


def rotate(log: DataFrame, entries: DataFrame, snapshot: DataFrame | None, segment: int, now_ms: int, limit: int) -> tuple[DataFrame | None, int]:
    """The cumulative snapshot and the open segment: another one, and a new snapshot, if the open one has outgrown the limit.

    A closed segment keeps its rows; what is appended later goes to the segment returned. Tombstones stay in the snapshot.
    """
    due = should_rotate(log.filter(F.col("segment") == segment), limit).first()
    if due is None or not due["rotate"]:
        return snapshot, segment
    now = cumulative_snapshot(snapshot, entries.select(*snapshot.columns)) if snapshot is not None else entries
    return now, max(now_ms, segment + 1)


def root_snapshot(files: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: files, bytes, tracked entries, tombstones and pending conflicts."""
    f = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    e = entries.agg(
        F.count_if(~F.col("deleted")).alias("tracked"), F.count_if(F.col("deleted")).alias("tombstones"), F.count_if(~F.col("deleted") & F.col("conflict_of").isNotNull()).alias("conflicts"))
    return f.crossJoin(e)  # two single rows


def resolve_ids(folders: DataFrame) -> DataFrame:
    """``id, path`` of objects given as ``id, parent, name``, parents of top ones being null.

    Each round doubles how far up an object's path is known, so the deepest tree takes the logarithm of its depth.
    Objects below one that is not there have no path; a cycle is an error.
    """
    paths, rounds = keep(folders.select("id", F.col("parent").alias("up"), F.col("name").alias("path")), "ids"), 0
    total = paths.count()
    while not paths.filter("up is not null").isEmpty():
        if 1 << rounds > total:
            raise ValueError("folders form a cycle")
        above = paths.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        longer = paths.filter("up is not null").join(above, "up").select("id", F.col("_up").alias("up"), F.concat_ws("/", "_path", "path").alias("path"))
        paths, rounds = keep(paths.filter("up is null").unionByName(longer), "ids"), rounds + 1
    return paths.select("id", "path")


def id3_size(content):
    """Length of an ID3v2 tag at the start of bytes, header included, from four 7-bit digits; 0 without one."""
    digit = lambda i: F.conv(F.hex(F.substring(content, i, 1)), 16, 10).cast("bigint")
    size = ((digit(7) * 128 + digit(8)) * 128 + digit(9)) * 128 + digit(10)
    return F.when(F.substring(content, 1, 3) == F.lit(b"ID3"), size + 10).otherwise(F.lit(0).cast("bigint"))
