"""A plan carried out on a store of files: bytes are staged and checked first, and only then does anything change.

Every step is a job over a table of paths whose tasks may run twice: what a first run did is found done. Staging is most of
the work and touches nothing that is seen; each file then comes into place by one rename, so at any moment it is
the old one or the new one, whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import entry_rows
from ..schema import CONTROL_DIR
from ..sources.adapter import Adapter, tasks
from .scratch import keep, run

STAGE = f"{CONTROL_DIR}/stage"


class WrongContent(ValueError):
    """Bytes that do not have the hash asked for."""


def staged_name(stage: str, path: str) -> str:
    name = hashlib.sha256(path.encode()).hexdigest()
    return f"{stage}/{name[:2]}/{name}"  # tasks that share a directory wait for each other


def _staged(adapter: Adapter, stage: str):
    """Streams rows ``path, hash, start, content, source`` (in order) into the stage; a row for each file that is whole and right."""
    names, types = ["path", "staged", "hash", "size"], [pa.string(), pa.string(), pa.string(), pa.int64()]

    def finish(path: str, wanted: str, temp: str, sink, sha, size: int) -> tuple:
        sink.close()
        if sha.hexdigest() != wanted:
            adapter.delete(temp)
            raise WrongContent(f"{path} would arrive as {sha.hexdigest()}, not {wanted}")
        adapter.rename(temp, staged_name(stage, path))
        return path, staged_name(stage, path), wanted, size

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        path = wanted = temp = sink = sha = None
        size = 0
        for batch in batches:
            for p, h, content, source in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if p != path:
                    if path is not None:
                        out.append(finish(path, wanted, temp, sink, sha, size))
                    # a name of its own, as another run of this task may write the same file right now
                    path, wanted, temp, sha, size = p, h, f"{staged_name(stage, p)}.{uuid.uuid4().hex}", hashlib.sha256(), 0
                    sink = adapter.create(temp)
                for data in adapter.read(source) if source is not None else (content or b"",):
                    sink.write(data)
                    sha.update(data)
                    size += len(data)
        if path is not None:
            out.append(finish(path, wanted, temp, sink, sha, size))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run_


def each(rows: DataFrame, step: Callable[..., None]) -> int:
    """Run a step for every row, with its columns as arguments; how many rows there were."""
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                step(*row)
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["done"])

    return rows.mapInArrow(run_, "done bigint").agg(F.coalesce(F.sum("done"), F.lit(0))).first()[0]


def move(adapter: Adapter, path: str, to: str) -> None:
    """A rename that may have been done before."""
    if adapter.stat(path) is not None:
        adapter.rename(path, to)


def place(adapter: Adapter, staged: str, path: str) -> None:
    """A staged file in its place; that it is neither staged nor there is an error."""
    if adapter.stat(staged) is not None:
        adapter.rename(staged, path)
    elif adapter.stat(path) is None:
        raise FileNotFoundError(f"{path} is neither staged nor in place")


def drop_empty(adapter: Adapter, path: str) -> None:
    if adapter.stat(path) is not None and not adapter.list(path):
        adapter.delete(path)


def stage_writes(adapter: Adapter, stage: str, wanted: DataFrame, current: DataFrame, contents: DataFrame) -> DataFrame:
    """``path, staged, hash, size`` of all files that ``wanted`` (path, hash) asks for, each checked while it was written.

    What the store holds under another path, or the same, is copied from there; the rest comes from ``contents`` (hash,
    content, and start where a content is in parts), for one path a content, from where other paths copy it. A content that
    neither has, or that does not have its hash, is an error.
    """
    live = entry_rows(current).filter("not deleted and kind = 'file' and hash is not null and held is null")
    mine = live.groupBy("hash").agg(F.min("path").alias("source"))
    x = keep(wanted.join(mine, "hash", "left"), "wanted")
    asked = x.filter("source is null").groupBy("hash").agg(F.min("path").alias("path"))
    start = F.col("start") if "start" in contents.columns else F.lit(0)
    parts = contents.select("hash", start.cast("bigint").alias("start"), F.col("content").cast("binary").alias("content"))
    if "start" in contents.columns:
        far = parts.join(asked.select("hash"), "hash", "left_semi").dropDuplicates(["hash", "start"]).join(asked, "hash").repartition("path")
    else:
        # contents move once, by hash; equal ones meet before
        far = parts.dropDuplicates(["hash"]).join(asked.select("hash"), "hash", "left_semi").join(asked, "hash")
    none = F.lit(None)
    far = far.sortWithinPartitions("path", "start").select("path", "hash", "start", "content", none.cast("string").alias("source"))
    types = "path string, staged string, hash string, size bigint"
    first = keep(far.mapInArrow(_staged(adapter, stage), types), "staged")
    here = x.join(first.select("hash", F.col("path").alias("at"), "staged"), "hash", "left").filter("at is null or at <> path").withColumn("source", F.coalesce("source", "staged")).filter("source is not null")
    # rows without content do not tell how long copying takes
    dealt = here.repartition(tasks(wanted.sparkSession), "path").select("path", "hash", F.lit(0).cast("bigint").alias("start"), none.cast("binary").alias("content"), "source")
    staged = first.unionByName(keep(dealt.mapInArrow(_staged(adapter, stage), types), "copied"))
    missing = wanted.join(staged.select("path"), "path", "left_anti").select("path").limit(3).collect()
    if missing:
        raise WrongContent(f"no content for {[r['path'] for r in missing]}")
    return staged


def apply_plan(adapter: Adapter, target: DataFrame, actions: DataFrame, current: DataFrame, contents: DataFrame) -> dict[str, int]:
    """Bring a store from ``current`` entries to ``target`` by the actions of plan_actions; how many of each kind there were.

    The order is: all bytes staged, deletes, files that move set aside and put in their new places (so that swaps and chains
    need no order), folders, writes. Held contents have no action. If staging fails, nothing has changed.
    """
    spark, stage = target.sparkSession, f"{STAGE}/{uuid.uuid4().hex}"
    with run(spark, "apply"):
        acts = keep(actions.select("uuid", "type", "kind", "path", "from_path"), "actions")
        of = lambda type_, kind=None: acts.filter((F.col("type") == type_) & (F.lit(True) if kind is None else F.col("kind") == kind))
        try:
            wanted = of("write").select("uuid", "path").join(target.select("uuid", "hash"), "uuid").select("path", "hash")
            staged = stage_writes(adapter, stage, wanted, current, contents)
            done = {"delete": each(of("delete", "file").select("path"), adapter.delete) + each(of("delete", "directory").select("path"), adapter.delete)}
            moves = of("rename", "file").select("from_path", F.concat(F.lit(f"{stage}/move-"), F.sha2("uuid", 256)).alias("aside"), "path")
            done["rename"] = each(moves.select("from_path", "aside"), lambda a, b: move(adapter, a, b))
            each(moves.select("aside", "path"), lambda a, b: move(adapter, a, b))
            folders = of("mkdir").select("path").unionByName(of("rename", "directory").select("path"))
            done["mkdir"] = each(folders, adapter.mkdir)
            done["write"] = each(staged.select("staged", "path"), lambda a, b: place(adapter, a, b))
            left = keep(of("rename", "directory").select("from_path", F.length("from_path").alias("n")), "left")
            for n in [r["n"] for r in left.select("n").distinct().orderBy(F.desc("n")).collect()]:  # deepest first
                each(left.filter(F.col("n") == n).select("from_path"), lambda path: drop_empty(adapter, path))
            return done
        finally:
            adapter.delete(stage)
