"""Three-way merging of texts by lines, as an Arrow UDF; all or nothing, never with markers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MAX_LCS_CELLS, MAX_TEXT_MERGE
from .lineage import common_ancestor
from .logset import with_op

RESULT = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("reason", T.StringType())])


#: Characters of merged texts that a task holds as Python's before they are Arrow's.
HELD = 1 << 20


def endings(text: str) -> str:
    crlf, lf = text.count("\r\n"), text.count("\n")
    return "none" if not lf else "crlf" if crlf == lf else "lf" if not crlf else "mixed"


def split_lines(text: str) -> list[str]:
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def line_changes(base: list[str], side: list[str], cells: int = MAX_LCS_CELLS) -> list[tuple[int, int, list[str]]] | None:
    """What a side puts in place of base[start:end], in order; None where the differing middles are too large."""
    head = 0
    while head < min(len(base), len(side)) and base[head] == side[head]:
        head += 1
    tail = 0
    while tail < min(len(base), len(side)) - head and base[-1 - tail] == side[-1 - tail]:
        tail += 1
    x, y = base[head : len(base) - tail], side[head : len(side) - tail]
    if len(x) * len(y) > cells:
        return None
    code = {line: i for i, line in enumerate(dict.fromkeys(x + y))}
    p, q = np.array([code[v] for v in x], int), np.array([code[v] for v in y], int)
    # longest common subsequence lengths of all suffixes, a row at a time: a running maximum from the right
    table = np.zeros((len(p) + 1, len(q) + 1), np.int32)
    for i in range(len(p) - 1, -1, -1):
        row = np.maximum(table[i + 1, :-1], np.where(q == p[i], table[i + 1, 1:] + 1, 0))
        table[i, :-1] = np.maximum.accumulate(row[::-1])[::-1] if len(q) else row
    kept, i, j = [], 0, 0
    while i < len(p) and j < len(q):
        if p[i] == q[j]:
            kept.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    out, at, to = [], 0, 0
    for i, j in [*kept, (len(x), len(y))]:
        if i > at or j > to:
            out.append((head + at, head + i, y[to:j]))
        at, to = i + 1, j + 1
    return out


def _patched(base: list[str], changes: list[tuple[int, int, list[str]]], start: int, end: int) -> list[str]:
    out, at = [], start
    for a, b, lines in changes:
        out += base[at:a] + lines
        at = b
    return out + base[at:end]


def merge_texts(base: str, a: str, b: str, size: int = MAX_TEXT_MERGE) -> tuple[bool, str | None, str | None]:
    """(ok, text, reason); reasons are size, eol and block. Changes that only touch both apply."""
    if max(map(len, (base, a, b))) > size:
        return False, None, "size"
    kinds = {endings(t) for t in (base, a, b)} - {"none"}
    if "mixed" in kinds or len(kinds) > 1:
        return False, None, "eol"
    lines = split_lines(base)
    both = [line_changes(lines, split_lines(t)) for t in (a, b)]
    if None in both:
        return False, None, "size"
    # all changes by place, gathered into groups whose base ranges overlap
    todo = sorted((c[0], c[1], who, c) for who in (0, 1) for c in both[who])
    groups: list[tuple[int, int, list, list]] = []
    for start, end, who, change in todo:
        last = groups[-1] if groups else None
        if last and (start < last[1] or start == last[0] == last[1]):
            last[2 + who].append(change)
            groups[-1] = (last[0], max(last[1], end), last[2], last[3])
        else:
            groups.append((start, end, [change] if who == 0 else [], [change] if who == 1 else []))
    out, at = [], 0
    for start, end, mine, theirs in groups:
        out += lines[at:start]
        versions = [_patched(lines, c, start, end) for c in (mine, theirs) if c]
        if len(versions) == 2 and versions[0] != versions[1]:
            return False, None, "block"
        out += versions[0]
        at = end
    return True, "".join(out + lines[at:]), None


@F.arrow_udf(RESULT)
def diff3(base: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    """Texts become Python's one row at a time, and results are Arrow's again after ``HELD`` characters."""
    kind, out, rows, held = pa.struct([("ok", pa.bool_()), ("text", pa.string()), ("reason", pa.string())]), [], [], 0
    for x, y, z in zip(base, a, b, strict=True):
        rows.append(dict(zip(("ok", "text", "reason"), merge_texts(x.as_py(), y.as_py(), z.as_py()), strict=True)))
        held += len(rows[-1]["text"] or "")
        if held > HELD:
            out.append(pa.array(rows, kind))
            rows, held = [], 0
    return pa.concat_arrays([*out, pa.array(rows, kind)])


def merge_text_columns(rows: DataFrame, base: str = "base", a: str = "a", b: str = "b") -> DataFrame:
    """``rows`` with ``merged``; texts over the size limit never leave the JVM."""
    small = (F.length(base) <= MAX_TEXT_MERGE) & (F.length(a) <= MAX_TEXT_MERGE) & (F.length(b) <= MAX_TEXT_MERGE)
    too_large = F.struct(F.lit(False).alias("ok"), F.lit(None).cast("string").alias("text"), F.lit("size").alias("reason"))
    near = rows.filter(small).withColumn("merged", diff3(F.col(base), F.col(a), F.col(b)))
    return near.unionByName(rows.filter(~F.coalesce(small, F.lit(False))).withColumn("merged", too_large))


def merge_conflicts(conflicts: DataFrame, edges: DataFrame, contents: DataFrame, bases: DataFrame, at_ms: int, peer_a: str, resolve=None) -> DataFrame:
    """Text conflicts that merge, with their text: ``uuid, hash, size, updated, peer, prev, prev2, text, copy``.

    conflicts are those of merge_entries; contents and bases hold ``hash, text``. The base is the nearest version that both
    sides come from; without its text nothing merges by itself. ``resolve``, a pandas UDF of path, base, a and b, is asked
    for what did not merge; its null leaves the conflict as it is. The result descends from both versions.
    """
    asked = conflicts.filter(F.col("is_text") & (F.col("larger") <= MAX_TEXT_MERGE))
    pairs = common_ancestor(asked.select("uuid", F.col("left_hash").alias("left"), F.col("right_hash").alias("right")), edges)
    x = asked.join(pairs.select("uuid", F.col("base").alias("base_hash")), "uuid")
    with_text = lambda df, key, name, source, how: df.join(source.select(F.col("hash").alias(key), F.col("text").alias(name)).dropDuplicates([key]), key, how)
    x = with_text(with_text(with_text(x, "left_hash", "a", contents, "inner"), "right_hash", "b", contents, "inner"), "base_hash", "base", bases, "left")
    known = merge_text_columns(x.filter("base is not null")).withColumn("out", F.when(F.col("merged.ok"), F.col("merged.text"))).drop("merged")
    x = known.unionByName(x.filter("base is null").withColumn("out", F.lit(None).cast("string")))
    if resolve is not None:
        x = x.withColumn("out", F.when(F.col("out").isNull(), resolve("path", "base", "a", "b")).otherwise(F.col("out")))
    won, lost = F.when(F.col("winner") == "a", F.col("left_hash")).otherwise(F.col("right_hash")), F.when(F.col("winner") == "a", F.col("right_hash")).otherwise(F.col("left_hash"))
    return x.filter("out is not null").select(
        "uuid", F.sha2("out", 256).alias("hash"), F.octet_length("out").cast("bigint").alias("size"), (F.greatest(F.lit(at_ms), F.col("newest")) + 1).alias("updated"),
        F.lit(peer_a).alias("peer"), won.alias("prev"), lost.alias("prev2"), F.col("out").alias("text"), "copy")


def settle_texts(entries: DataFrame, merged: DataFrame) -> DataFrame:
    """Entries with merged texts in place of the winners, and without the copies that only waited for a decision."""
    fields = ("hash", "size", "updated", "peer", "prev", "prev2")
    rest = entries.join(merged.filter("copy is not null").select(F.col("copy").alias("uuid")), "uuid", "left_anti")
    new = merged.select("uuid", F.struct(*fields).alias("_m"))
    return rest.join(new, "uuid", "left").select(*(F.when(F.col("_m").isNotNull(), F.col(f"_m.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in entries.columns))


def text_rows(entries: DataFrame, merged: DataFrame, batch: str) -> DataFrame:
    """Log rows of merged texts: writes with two parents, which keep other peers from seeing a new conflict."""
    x = merged.join(entries.select("uuid", "path"), "uuid")
    return with_op(x.select(F.lit(batch).alias("batch"), F.col("updated").alias("at_ms"), "peer", "uuid", F.lit("write").alias("type"), F.lit("file").alias("kind"), "path", "hash", "size", "prev", "prev2"))
