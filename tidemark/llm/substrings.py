"""Removal of repeated word windows by level-wise doubling.

A window of ``SPAN`` words is repeated when its word sequence starts at two places or more of the corpus.
Every window is represented by one short run in it, its anchor: the ``FIRST``-word run of smallest hash.
Equal windows have equal anchors at equal places, so only anchors are counted at first, one row for all
windows that follow each other and have the same anchor.

Level 1 (9 words): anchors are counted; those that stand at one place alone go, with all their windows.
Level 2 (18 words): what survived is extended to twice the length, to the left and to the right. One of the two
lies within any window of an anchor, so an anchor with neither repeated goes.
Level 3 (35 words and more): the stretch of all windows of an anchor is counted; where it is repeated, all its
windows are. Of the other survivors the windows themselves are counted, with one copy of each repeated stretch
of the same anchor to compare with.

Each level is a count by key that combines before the shuffle, and a semi-join with the keys that stand twice or
more; what a level leaves is written and is all that the next one reads. The keys are written first, so that a
join meets two freshly dealt tables and a passage of a third of all texts can be split among tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .text import Rolling, Words, mix, pieces, window_ids

FIRST, SPAN = 9, 35
RUN = 1_000_000  # words whose anchors are found at once
TWIST = 0xD6E8FEB86659FD93


def anchors(hashes: np.ndarray, offsets: np.ndarray, first: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places of all windows, and the first and last window of each: ``at, lo, hi``, all by word."""
    starts = window_ids(offsets, span)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z
    width = span - first + 1
    value = mix(Rolling(TWIST)(hashes, runs := np.arange(len(hashes) - first + 1), runs + first))
    place = runs
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = value[:-step], value[step:]
        take = left <= right
        value, place = np.where(take, left, right), np.where(take, place[:-step], place[step:])
        reach += step
    at = place[starts]
    own = np.searchsorted(offsets, starts, "right")
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    lo = starts[new]
    hi = starts[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    return at[new], lo, hi


def _find_anchors(first: int, span: int):
    """Hashes of each anchor's run ``g``, its doubles ``l`` and ``r`` (0 where the text ends before) and its stretch ``u``."""

    def run(batches):
        words = Words()
        for batch in batches:
            for rows, data, offsets in pieces(batch, "text"):
                _, _, h, at = words(data, offsets)
                ids = rows.column(0).to_numpy(zero_copy_only=False)
                for begin in range(0, max(1, len(h)), RUN):
                    end = min(len(h), begin + RUN + span - 1)
                    own, edges = h[begin:end], np.clip(at, begin, end) - begin
                    a, lo, hi = anchors(own, edges, first, span)
                    if not len(a):
                        continue
                    rolling = Rolling(TWIST)
                    row = np.searchsorted(edges, lo, "right") - 1
                    base, last = edges[row], edges[row + 1]
                    left, right = np.maximum(a - first, base), np.minimum(a + 2 * first, last)
                    twice = lambda x, y, fits: np.where(fits, mix(rolling(own, x, y)) | np.uint64(1), 0).view(np.int64)
                    shift = begin - at[row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row]), pa.array((lo + shift).astype(np.int32)), pa.array((hi + shift).astype(np.int32)), pa.array(mix(rolling(own, a, a + first)).view(np.int64)),
                         pa.array(twice(left, a + first, a - first >= base)), pa.array(twice(a, right, a + 2 * first <= last)),
                         pa.array(mix(rolling(own, lo, hi + span) + (hi - lo).astype(np.uint64)).view(np.int64))], names=["rid", "lo", "hi", "g", "l", "r", "u"])

    return run


def _hash_windows(span: int):
    """``rid, start, h, copy`` of all windows of the items of a text."""

    def run(batches):
        words, rolling = Words(), Rolling(TWIST)
        for batch in batches:
            items, rids = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("items", "rid"))
            k = 0
            for rows, data, offsets in pieces(batch, "text"):
                _, _, h, at = words(data, offsets)
                held = []
                for i in range(rows.num_rows):
                    own = h[at[i] : at[i + 1]]
                    for copy in (False, True):
                        s = [np.arange(x["lo"], x["hi"] + 1) for x in items[k + i] if x["copy"] == copy]
                        if s:
                            s = np.concatenate(s)
                            held.append((np.full(len(s), rids[k + i], np.int64), s.astype(np.int32), mix(rolling(own, s, s + span)).view(np.int64), np.full(len(s), copy)))
                k += rows.num_rows
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["rid", "start", "h", "copy"])

    return run


def kept_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> bytes:
    """The kept words of a text, joined by one space."""
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return b""
    change = np.zeros(len(data) + 1, np.int8)
    change[starts] += 1
    change[ends] -= 1
    inside = np.cumsum(change[:-1], dtype=np.int8) > 0
    out = data.copy()
    out[ends[:-1]] = 32  # a gap follows every word but a text's last
    inside[ends[:-1]] = True
    return out[inside].tobytes()


def _finish(span: int):
    def run(batches):
        words = Words()
        for batch in batches:
            cuts = batch.column(batch.schema.get_field_index("cuts")).to_pylist()
            k = 0
            for rows, data, offsets in pieces(batch, "text"):
                starts, ends, _, at = words(data, offsets)
                gone, digest = [], []
                for i in range(rows.num_rows):
                    change = np.zeros(at[i + 1] - at[i] + 1, np.int64)
                    for c in cuts[k + i] or ():
                        change[c["lo"]] += 1
                        change[c["hi"] + span] -= 1
                    keep = np.cumsum(change)[:-1] == 0
                    own = slice(at[i], at[i + 1])
                    gone.append(int((~keep).sum()))
                    digest.append(hashlib.sha256(kept_bytes(data[offsets[i] : offsets[i + 1]], starts[own] - offsets[i], ends[own] - offsets[i], keep)).hexdigest())
                k += rows.num_rows
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at)), pa.array(gone, pa.int64()), pa.array(digest)], names=["id", "n_words", "n_removed", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = SPAN, first: int = FIRST) -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256`` for every row of docs.

    A word goes if a window of ``span`` words that covers it stands anywhere else too, in the same row or
    another; all windows are judged on the input. A null or empty text has no words. Rows that repeat are copies
    of each other. Columns besides id and text are ignored; an empty table gives no rows. A long text takes about
    ten times its size in one task. ``first`` is the anchors' length, at most (span + 1) / 3. The result is a
    table in the shared folder; all others that the levels wrote are removed.
    """
    if not 1 <= 3 * first - 1 <= span:
        raise ValueError("first must be at most (span + 1) / 3")
    scratch = Scratch(docs.sparkSession, "substrings")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), F.col(text)).alias("rid"), F.col(text).cast("string").alias("text"))
    twice = lambda rows, key, name: scratch.save(rows.groupBy(key).agg(F.count("*").alias("m")).filter("m > 1").select(key), name)

    found = scratch.save(source.select("rid", "text").mapInArrow(_find_anchors(first, span), "rid long, lo int, hi int, g long, l long, r long, u long"), "anchors")
    one = scratch.save(found.join(twice(found, "g", "runs"), "g", "left_semi"), "level-1")
    left = twice(one.filter("l <> 0"), "l", "left").withColumn("_l", F.lit(True))
    right = twice(one.filter("r <> 0"), "r", "right").withColumn("_r", F.lit(True))
    two = scratch.save(one.join(left, "l", "left").join(right, "r", "left").filter("_l or _r").select("rid", "lo", "hi", "g", "u"), "level-2")
    whole = twice(two, "u", "stretches").withColumn("_u", F.lit(True))
    three = scratch.save(two.join(whole, "u", "left").select("rid", "lo", "hi", "g", "u", F.col("_u").isNotNull().alias("whole")), "level-3")

    marks = three.filter("whole").select("rid", "lo", "hi")
    open_ = three.filter("not whole")
    if not open_.isEmpty():
        asked = scratch.save(open_.select("g").distinct(), "open-runs")
        copies = three.filter("whole").join(asked, "g", "left_semi").dropDuplicates(["u"])
        items = open_.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)))
        items = items.groupBy("rid").agg(F.collect_set(F.struct("lo", "hi", "copy")).alias("items"))
        windows = scratch.save(source.select("rid", "text").join(items, "rid").mapInArrow(_hash_windows(span), "rid long, start int, h long, copy boolean"), "windows")
        starts = windows.filter("not copy").join(twice(windows, "h", "window-keys"), "h", "left_semi")
        marks = marks.union(starts.select("rid", F.col("start").alias("lo"), F.col("start").alias("hi")))
    cuts = scratch.save(marks.groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("cuts")), "cuts")
    last = source.join(cuts, "rid", "left").select("id", "text", "cuts").mapInArrow(_finish(span), "id long, n_words long, n_removed long, kept_sha256 string")
    return scratch.last(last.withColumnRenamed("id", id_col))
