"""Bytes: ranges, chunks, lookups by hash, and the files of a side after a plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CHUNK_SIZE
from .edits import write_file


def byte_range(content: Column, start: int, end: int) -> Column:
    """Half-open and clamped."""
    return F.substring(content, start + 1, max(0, end - start))


def chunks(files: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """``path, i, chunk``; an empty content is one empty chunk, a null one has none."""
    n = F.greatest(F.lit(1), F.ceil(F.length("content") / F.lit(size)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr("content", i * size + 1, F.lit(size)))
    return files.select("path", F.posexplode(F.when(F.col("content").isNotNull(), cut)).alias("i", "chunk"))


def collect_chunks(parts: DataFrame) -> DataFrame:
    """The inverse: a file's chunks in order, as one content."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "chunk"))), lambda x: x["chunk"])
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, c: F.concat(a, c))
    return parts.groupBy("path").agg(joined.alias("content"))


def find_contents(hashes: DataFrame, *sources: DataFrame) -> DataFrame:
    """``hash, content`` from the first of the sources (hash, content) that has it."""
    ranked = reduce(lambda a, b: a.unionByName(b), (s.select("hash", "content").withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)))
    return hashes.select("hash").distinct().join(ranked, "hash", "inner").groupBy("hash").agg(F.min_by("content", "_rank").alias("content"))


def apply_target(target: DataFrame, contents: DataFrame, me: str) -> DataFrame:
    """The files of a side once the target holds: ``path, kind, size, content``, all moves at once.

    A content that does not have the hash asked for, or is missing, is an error.
    """
    held = F.coalesce(F.col("held") != me, F.lit(False)) if "held" in target.columns else F.lit(False)
    want = target.filter(~F.col("deleted")).filter(~held).select("path", "kind", "hash", "size")
    x = want.join(contents.select("hash", "content"), "hash", "left")
    bad = (F.col("kind") == "file") & ~F.coalesce(F.sha2("content", 256) == F.col("hash"), F.lit(False))
    content = F.when(bad, F.raise_error(F.concat(F.lit("wrong or missing content for "), F.col("path"))).cast("binary")).otherwise(F.col("content"))
    return x.select("path", "kind", "size", content.alias("content"))


def resolve_conflict(files: DataFrame, path: str, copy_path: str, take: str) -> DataFrame:
    """Files with a conflict settled: 'mine' drops the copy, 'theirs' also puts its content in place. Both files must be there."""
    if take not in ("mine", "theirs"):
        raise ValueError("take is 'mine' or 'theirs'")
    found = {r["path"] for r in files.filter(F.col("path").isin(path, copy_path)).select("path").distinct().collect()}  # two paths at most
    if found != {path, copy_path}:
        raise ValueError(f"no such conflict: {sorted({path, copy_path} - found)}")
    if take == "mine":
        return files.filter(F.col("path") != copy_path)
    return files.filter(F.col("path") != path).withColumn("path", F.when(F.col("path") == copy_path, path).otherwise(F.col("path")))


def resolve_pending(files: DataFrame, entries: DataFrame, uuid: str, choice: str | bytes, me: str) -> DataFrame:
    """Files with the conflict settled whose copy has this uuid: 'mine' drops the copy, 'theirs' puts its content in the disputed
    file's place, and bytes are written there. A disputed entry that is gone only loses its copy.

    A copy that is not there is an error, and so is 'theirs' where its bytes are held on another peer.
    """
    if not isinstance(choice, bytes) and choice not in ("mine", "theirs"):
        raise ValueError("choice is 'mine', 'theirs' or bytes")
    known = entries.select("uuid", "path", "conflict_of", *(["held"] if "held" in entries.columns else [F.lit(None).cast("string").alias("held")]))
    copy = known.filter((F.col("uuid") == uuid) & F.col("conflict_of").isNotNull()).first()
    if copy is None:
        raise KeyError(f"no pending conflict {uuid}")
    disputed = known.filter(F.col("uuid") == copy["conflict_of"]).first()
    if choice == "theirs" and copy["held"] not in (None, me):
        raise ValueError(f"the losing version of {copy['path']} is held on {copy['held']}")
    out = files
    if disputed is not None and choice == "theirs":
        out = out.filter(F.col("path") != disputed["path"]).withColumn("path", F.when(F.col("path") == copy["path"], disputed["path"]).otherwise(F.col("path")))
    elif disputed is not None and isinstance(choice, bytes):
        out = write_file(out, disputed["path"], choice)
    return out.filter(F.col("path") != copy["path"])


def scoped(files: DataFrame, root: str) -> DataFrame:
    """Files below a root, their paths taken from there."""
    return files.filter(F.startswith("path", F.lit(root + "/"))).withColumn("path", F.expr(f"substring(path, {len(root) + 2})")) if root else files


def rerooted(files: DataFrame, root: str) -> DataFrame:
    return files.withColumn("path", F.concat(F.lit(root + "/"), F.col("path"))) if root else files
