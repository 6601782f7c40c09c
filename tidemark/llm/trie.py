"""The prefix trie of conversations, by preorder intervals.

A node is a distinct sequence of first turns. Its key is a chain of digests over these turns, so equal sequences meet
by key. A conversation is the path of the keys of its nodes, end to end; distinct paths in lexicographic order make a
node's members a run of neighbours, and nodes in order of (first member's rank, depth) stand in preorder. Each node
opens at its first member's rank and closes at its last one's; running sums over all openings and closings, worked out
a partition at a time and shifted by the partitions before, give its place in preorder, the place where its subtree
ends, and as differences the leaves and savings of the subtree.

Conversations that are the same are one path with a count, so the size of a group of copies plays no part in what
follows. Only the digest of a node's ends is sequential by definition: runs of ids are hashed where they are sorted, and
those that reach across partitions come together as blocks of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

#: Bytes of a node's key.
KEY = 16
#: Bytes that a task sends on at once.
FLUSH = 4_000_000
#: Bytes of joined ids in a block.
BLOCK = 65_536


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the length keeps role and text apart."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def _walk(heads: int):
    """Paths of conversations, from turns in order of block, conversation (the block's own first) and turn."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        block = conv = None
        first: list[tuple[bytes, int]] = []  # the first turns of the block's own conversation
        path, tokens, key, at = bytearray(), [], b"", 0

        def step(digest: bytes, n: int) -> None:
            nonlocal key
            key = hashlib.sha256(key + digest).digest()[:KEY]
            path.extend(key)
            tokens.append(n)

        def flush() -> pa.RecordBatch:
            ids, paths, counts = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.binary()), pa.array(counts, pa.list_(pa.int32()))], names=["conv_id", "path", "tokens"])

        for batch in batches:
            for b, c, h, digest, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    if conv is not None:
                        out.append((conv, bytes(path), tokens))
                        held += 2 * len(path) + 64
                        if held >= FLUSH:
                            yield flush()
                            out, held = [], 0
                    if b != block:
                        block, first = b, []
                    conv, path, tokens, key, at = c, bytearray(), [], b"", 0
                    if c != b:
                        for turn in first[:h]:
                            step(*turn)
                if c == b and at < heads:
                    first.append((digest, n))
                if c == b or at >= h:
                    step(digest, n)
                at += 1
        if conv is not None:
            out.append((conv, bytes(path), tokens))
            yield flush()

    return run


def conversation_paths(conversations: DataFrame, block: Column | None = None, taken: Column | None = None, heads: int = 3) -> DataFrame:
    """``conv_id, path, tokens`` of each conversation: the keys of its nodes end to end, and the words of each turn.

    Where ``block`` and ``taken`` are given, a conversation takes its first ``taken`` turns (at most ``heads``) from the
    conversation whose id is ``block``, as many as that has, and then has its own turns after its first ``taken``; a block
    must be its own block. Turns stand in order of ``turn``, null first; turns of one number in order of their digests.
    Only digests and counts of words are shuffled, not texts. Rows without conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = F.col("conv_id").cast("long")
    turns = conversations.filter(own.isNotNull()).select(
        (own if block is None else block.cast("long")).alias("block"), own.alias("conv"), (F.lit(0) if taken is None else taken).cast("int").alias("taken"), F.col("turn").alias("turn"),
        F.unhex(turn_digest(role, text)).alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    order = ["block", F.col("conv") != F.col("block"), "conv", F.asc_nulls_first("turn"), "digest"]
    placed = turns.repartition("block").sortWithinPartitions(*order).select("block", "conv", "taken", "digest", "words")
    return placed.mapInArrow(_walk(heads), "conv_id long, path binary, tokens array<int>")


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of all that stands before each row of a partition, and a last row of kind 2 with the sums of all."""
    total, part = np.zeros(3, np.int64), None
    names = ["part", "key", "kind", "nodes", "leaves", "saved"]
    for batch in batches:
        part = batch.column(0)[0].as_py() if batch.num_rows else part
        out = []
        for j in range(3):
            values = batch.column(3 + j).to_numpy(zero_copy_only=False)
            out.append(pa.array(total[j] + np.cumsum(values) - values))
            total[j] += values.sum()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *out], names=names)
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([None], pa.binary()), pa.array([2], pa.int32()), *(pa.array([int(t)], pa.int64()) for t in total)], names=names)


def _end_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted ``key, conv_id``: the digest of each run of one key, or blocks of its text.

    Text leaves for runs of more than a block, and for a partition's first and last run, which may go on elsewhere.
    """
    types, names = (pa.binary(), pa.int64(), pa.string(), pa.string()), ["key", "first", "block", "digest"]
    out: list[tuple] = []
    key, parts, size, text, held = None, [], 0, True, 0

    def end(whole: bool) -> None:
        joined = ",".join(map(str, parts))
        out.append((key, parts[0], joined, None) if text or not whole else (key, parts[0], None, hashlib.sha256(joined.encode()).hexdigest()))

    for batch in batches:
        for k, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if k != key:
                if key is not None:
                    end(True)
                    text, held = False, held + 200 + (size if text else 0)
                key, parts, size = k, [], 0
            elif size >= BLOCK:
                text = True
                end(False)
                parts, size, held = [], 0, held + size
            if held >= FLUSH:
                yield _rows(out, types, names)
                out, held = [], 0
            parts.append(c)
            size += 20
    if key is not None:
        end(False)
    if out:
        yield _rows(out, types, names)


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key from its blocks in order."""
    types, names = (pa.binary(), pa.string()), ["key", "digest"]
    key, sha = None, None
    out: list[tuple] = []
    for batch in batches:
        for k, block in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k != key:
                if sha is not None:
                    out.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(block.encode())
            else:
                sha.update(b"," + block.encode())
        if len(out) > 10_000:
            yield _rows(out, types, names)
            out = []
    if sha is not None:
        out.append((key, sha.hexdigest()))
    if out:
        yield _rows(out, types, names)


def _rows(rows: list[tuple], types: tuple[pa.DataType, ...], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def end_digests(scratch: Scratch, ends: DataFrame) -> DataFrame:
    """``key, digest``: SHA-256 of each key's ids in ascending order, joined by commas."""
    runs = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_end_runs, "key binary, first long, block string, digest string")
    runs = scratch.save(runs, "end-runs")
    long = runs.filter("block is not null").select("key", "first", "block").repartition("key").sortWithinPartitions("key", "first")
    return runs.filter("digest is not null").select("key", "digest").unionByName(long.mapInArrow(_joined, "key binary, digest string"))


def subtree_sums(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """``key, preorder, subtree_end, leaves, saved`` of nodes ``key, low, high, depth, leaf, saved``.

    Places count from 0; a subtree is all that stands from preorder to subtree_end.
    """
    opening = F.struct(F.col("low").alias("rank"), F.lit(0).alias("kind"), F.col("depth").alias("at"), F.lit(1).cast("long").alias("nodes"), F.col("leaf").cast("long").alias("leaves"), F.col("saved").alias("saved"))
    none = F.lit(0).cast("long")
    closing = F.struct(F.col("high").alias("rank"), F.lit(1).alias("kind"), (-F.col("depth")).alias("at"), none.alias("nodes"), none.alias("leaves"), none.alias("saved"))
    marks = nodes.select("key", F.explode(F.array(opening, closing)).alias("m")).select("key", "m.*")
    placed = marks.repartitionByRange("rank", "kind", "at").sortWithinPartitions("rank", "kind", "at")
    sums = scratch.save(placed.select(F.spark_partition_id().alias("part"), "key", "kind", "nodes", "leaves", "saved").mapInArrow(_sums, "part int, key binary, kind int, nodes long, leaves long, saved long"), "sums")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    shift = sums.filter("kind = 2").select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("nodes", "leaves", "saved")))
    whole = sums.filter("kind < 2").join(F.broadcast(shift), "part").select("key", "kind", *((F.col(c) + F.col(f"_{c}")).alias(c) for c in ("nodes", "leaves", "saved")))
    signed = lambda c: F.sum(F.when(F.col("kind") == 1, F.col(c)).otherwise(-F.col(c)))
    at = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("nodes")))
    return whole.groupBy("key").agg(at(0).alias("preorder"), (at(1) - 1).alias("subtree_end"), signed("leaves").alias("leaves"), signed("saved").alias("saved"))


def prefix_trie(paths: DataFrame) -> DataFrame:
    """All nodes of the trie of ``paths`` (conv_id, path, tokens, as conversation_paths gives them), the root included.

    ``conv_id`` (the smallest member), ``depth, parent_conv_id`` (null for the root), ``n_convs, n_children, n_leaves,
    saved_tokens`` (over the subtree, the words of each node's last turn times its members but one), ``ends_sha256`` (of the
    ids of members that end here; without any, of the empty string), ``preorder`` and ``subtree_end``. Conversations
    without turns end at the root. No conversations give no rows, not even a root. The path of a conversation is one value
    of 16 bytes a turn. The result is a table in the shared folder; all others that were written are removed.
    """
    scratch = Scratch(paths.sparkSession, "trie")
    root = F.lit(b"")
    key_at = lambda d: F.when(d > 0, F.substr("path", (d - 1) * KEY + 1, F.lit(KEY))).otherwise(root)
    turns = (F.octet_length("path") / KEY).cast("int")
    own = scratch.save(paths.select("conv_id", "path", "tokens", turns.alias("turns")).withColumn("key", key_at(F.col("turns"))), "paths")
    alike = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("path").alias("path"), F.first("tokens").alias("tokens"), F.first("turns").alias("turns"))
    alike = scratch.save(alike, "distinct")
    # a number that grows along the order of paths is rank enough; it is fixed once it is written
    ranked = scratch.save(alike.repartitionByRange("path").sortWithinPartitions("path").withColumn("rank", F.monotonically_increasing_id()), "ranked")
    steps = ranked.select("rank", "n", "conv_id", "path", "tokens", "turns", F.explode(F.sequence(F.lit(0), F.col("turns"))).alias("depth"))
    steps = steps.select(
        key_at(F.col("depth")).alias("key"), F.when(F.col("depth") > 0, key_at(F.col("depth") - 1)).alias("parent"), "depth", F.when(F.col("depth") > 0, F.get("tokens", F.col("depth") - 1)).otherwise(0).cast("long").alias("words"),
        "rank", "n", "conv_id", "turns")
    nodes = steps.groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("rank").alias("low"), F.max("rank").alias("high"),
        F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("turns").alias("deepest"))
    nodes = scratch.save(nodes.withColumns({"leaf": F.col("deepest") == F.col("depth"), "saved": (F.col("n_convs") - 1) * F.col("words")}), "nodes")
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # written tables on both sides: the children of one parent can be split among tasks
    placed = nodes.join(above, "parent", "left").select("key", "conv_id", "depth", "parent_conv_id", "n_convs")
    full = placed.join(subtree_sums(scratch, nodes), "key").join(kids, "key", "left").join(end_digests(scratch, own.select("key", "conv_id")), "key", "left")
    return scratch.last(full.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "preorder", "subtree_end"))
