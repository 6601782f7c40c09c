"""Which versions descend from which, and where files came from."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch, within


def version_edges(*sources: DataFrame) -> DataFrame:
    """``uuid, hash, parent, branch`` from entries and log rows that have a hash; branch 0 is prev, 1 is prev2."""
    parts = []
    for s in sources:
        parents = [F.struct(F.lit(i).alias("branch"), F.col(c).alias("parent")) for i, c in enumerate(("prev", "prev2")) if c in s.columns]
        parts.append(s.filter(F.col("hash").isNotNull()).select("uuid", "hash", F.explode(F.array(*parents)).alias("p")).select("uuid", "hash", "p.parent", "p.branch"))
    edges = reduce(lambda a, b: a.unionByName(b), parts).filter(F.col("parent").isNotNull())
    return edges.groupBy("uuid", "hash", "parent").agg(F.min("branch").alias("branch"))


def location_edges(*sources: DataFrame) -> DataFrame:
    """``uuid, path, prev_path``: where a path was moved from; later sources, then later times, win."""
    parts = []
    for i, s in enumerate(sources):
        at = F.col("at_ms") if "at_ms" in s.columns else F.col("updated")
        parts.append(s.filter("prev_path is not null and prev_path <> path").select("uuid", "path", "prev_path", F.struct(F.lit(i).alias("source"), at.alias("at"), F.col("prev_path").alias("tie")).alias("place")))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.groupBy("uuid", "path").agg(F.max_by("prev_path", "place").alias("prev_path"))


def _seen(met: DataFrame, weighed: bool) -> tuple:
    """What tells rounds of climbing apart: versions met; with costs also how, as a longer way may be the cheaper one."""
    if not weighed:
        return (met.count(),)
    return tuple(met.agg(F.count(F.lit(1)), F.sum("depth"), F.bit_xor(F.xxhash64(*(c for c in met.columns)))).first())


def version_key(uuid, name) -> Column:
    """128 bits for a version of a file, in place of two long texts; null where either is."""
    uuid, name = (F.col(c) if isinstance(c, str) else c for c in (uuid, name))
    return F.substring(F.unhex(F.sha2(F.concat(F.length(uuid).cast("string"), F.lit(":"), uuid, name), 256)), 1, 16)


def plain_edges(edges: DataFrame) -> DataFrame:
    """``uuid, hash, parent, branch, node, up, lone``: each edge once, without those of a version to itself, and the keys of both ends.

    Edges are dealt by uuid; a lone one is that of a version's only parent to its only child.
    """
    n = lambda end: F.count(F.lit(1)).over(Window.partitionBy("uuid", end)) == 1
    marked = once(edges).withColumn("lone", n("hash")).withColumn("lone", n("parent") & F.col("lone"))
    return marked.withColumns({"node": version_key("uuid", "hash"), "up": version_key("uuid", "parent")})


def once(edges: DataFrame) -> DataFrame:
    """``uuid, hash, parent, branch``, dealt by uuid: each edge once, without those of a version to itself."""
    branch = F.col("branch").cast("int") if "branch" in edges.columns else F.lit(0)
    true = edges.filter("uuid is not null and hash is not null and parent is not null and hash <> parent").select("uuid", "hash", "parent", branch.alias("branch"))
    return true.repartition("uuid").groupBy("uuid", "hash", "parent").agg(F.min("branch").alias("branch"))


def _climb(scratch: Scratch, starts: DataFrame, edges: DataFrame) -> DataFrame:
    """As ``climb``, for nodes that are keys: starts have node, depth and path, edges ``node, up, way, cost``."""
    keys = [c for c in starts.columns if c not in ("node", "depth", "path")]
    aimed, weighed = "target" in keys, edges.schema["cost"].dataType.simpleString() != "int"
    near, jumps, step = scratch.save(starts, "near-0"), edges, 0
    while True:
        going = near.filter(~F.col("node").eqNullSafe(F.col("target"))) if aimed else near
        far = going.join(jumps, "node").select(*keys, F.col("up").alias("node"), (F.col("depth") + F.col("cost")).alias("depth"), F.concat("path", "way").alias("path"))
        best = F.min(F.struct("depth", "path")).alias("r")
        new = scratch.save(near.unionByName(far).groupBy(*keys, "node").agg(best).select(*keys, "node", "r.depth", "r.path"), f"met-{step}")
        if _seen(new, weighed) == _seen(near, weighed):
            break
        if aimed:
            met = new.filter("node = target")
            done = met.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
            same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
            new = scratch.save(new.join(done, same, "left_anti").unionByName(met), f"near-{step + 1}")
            scratch.drop(f"met-{step}")
        x, y = jumps, jumps.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("way").alias("on"), F.col("cost").alias("more"))
        longer = x.join(y, "up").groupBy("node", "top").agg(F.min(F.struct((F.col("cost") + F.col("more")).alias("cost"), F.concat("way", "on").alias("way"))).alias("r"))
        jumps = scratch.save(longer.select("node", F.col("top").alias("up"), "r.way", "r.cost"), f"jumps-{step + 1}")
        scratch.drop(*(n for n in (f"near-{step}", f"met-{step - 1}", f"jumps-{step}") if n in scratch.names))
        near, step = new, step + 1
    scratch.drop(*(n for n in list(scratch.names) if n.startswith(("near-", "jumps-")) or n.startswith("met-") and n != f"met-{step}"))
    return new


def climb(starts: DataFrame, edges: DataFrame, paths: bool = True) -> DataFrame:
    """All versions that starts reach: the columns of ``starts`` (uuid, node and others), with node, ``depth`` and ``path``.

    Depth 0 is the start itself; path is the branches taken, so the order of (depth, path) is that of a breadth-first
    search that looks at prev before prev2; without ``paths`` it is empty. Where starts have a ``target``, a start that has
    met it keeps that row alone and is followed no further.

    Starts and edges are dealt by uuid, and a task follows those of a history by itself, unless it has ``BLOCK`` rows (with paths a 64th). Longer
    ones go by rounds: each doubles the length of the jumps and follows one jump from all that is reached, so a chain of n
    versions takes log2(n) rounds, n rows of jumps each and n rows a start, not all pairs of versions. Cycles end as nothing
    new is reached. Rounds move keys and numbers of starts, names come back at the end.
    """
    scratch = within(starts.sparkSession, "climb")
    keys = [c for c in starts.columns if c not in ("uuid", "node")]
    begin = scratch.save(starts.distinct(), "begin", "zstd")
    columns = ["uuid", *keys, "node"]
    first = begin.select(*columns, F.lit(0).alias("depth"), F.lit("").alias("path"))
    if begin.isEmpty():
        return first
    way = F.coalesce(F.col("branch").cast("int"), F.lit(0)) if "branch" in edges.columns else F.lit(0)
    known = edges.join(begin.select("uuid").distinct(), "uuid", "left_semi").select("uuid", F.col("hash").alias("node"), F.col("parent").alias("other"), way.alias("way")).filter("uuid is not null and node is not null and other is not null")
    own = F.struct(*keys, F.lit(True).alias("_start"))
    named = "uuid is not null and node is not null"
    other = F.col("target") if "target" in keys else F.lit(None).cast("string")
    asked = begin.filter(named).select("uuid", "node", other.alias("other"), F.lit(0).alias("way"), own.alias("own"))
    rows = asked.unionByName(known.withColumn("own", F.lit(None).cast(asked.schema["own"].dataType)))
    dealt = rows.repartition("uuid").sortWithinPartitions("uuid").withColumns({"a": version_key("uuid", "node"), "b": version_key("uuid", "other")})
    schema = first.select("uuid", F.lit(None).cast(asked.schema["own"].dataType).alias("own"), "node", "depth", "path", F.lit(None).cast("boolean").alias("long")).schema
    near = scratch.save(dealt.mapInArrow(_climber("target" in keys, *((BLOCK >> 6, REACH >> 5) if paths else (BLOCK, REACH)), paths), schema), "near", "zstd")
    out = near.filter("not long").select("uuid", *(f"own.{k}" for k in keys), "node", "depth", "path").unionByName(first.filter(f"not ({named})"))
    far = near.filter("long").select("uuid", *(f"own.{k}" for k in keys), "node")
    return out if far.isEmpty() else out.unionByName(_climb_long(scratch, far, known if paths else known.withColumn("way", F.lit(None)), keys))


def _climb_long(scratch: Scratch, starts: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """As ``climb``, by rounds; edges have ``uuid, node, other, way``, and no path has a null way."""
    aimed = {"_target": version_key("uuid", "target")} if "target" in keys else {}
    begin = scratch.save(starts.withColumns({"_id": F.monotonically_increasing_id(), "_node": version_key("uuid", "node"), **aimed}), "long", "zstd")
    own = edges.join(begin.select("uuid").distinct(), "uuid", "left_semi")
    known = own.select(version_key("uuid", "node").alias("node"), version_key("uuid", "other").alias("up"), F.coalesce(F.col("way").cast("string"), F.lit("")).alias("way"), F.col("other").alias("name"))
    known = scratch.save(known, "known", "zstd")
    met = _climb(scratch, begin.select("_id", F.col("_node").alias("node"), *(F.col(c).alias("target") for c in aimed), F.lit(0).alias("depth"), F.lit("").alias("path")), known.select("node", "up", "way", F.lit(1).alias("cost")))
    names = known.select(F.col("up").alias("node"), "name").dropDuplicates(["node"])
    back = begin.select("_id", "uuid", *keys, F.col("node").alias("_name"))
    named = met.drop("target").join(names, "node", "left").join(back, "_id")
    return named.select("uuid", *keys, F.when(F.col("depth") == 0, F.col("_name")).otherwise(F.col("name")).alias("node"), "depth", "path")


#: Edges that a task follows together.
BLOCK = 1 << 18


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``u, node, at, steps`` of rows ``u, node, up``, a block at a time: how far the edges of the block lead from each."""

    def blocks():
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= BLOCK:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    for block in blocks():
        node, up = (block[c].combine_chunks() for c in ("node", "up"))
        then = pc.fill_null(pc.index_in(up, value_set=node), -1).to_numpy().astype(np.int64)
        last, steps = np.arange(len(then)), np.ones(len(then), np.int64)
        for _ in range(len(then).bit_length()):  # rings never end
            go = np.flatnonzero(then >= 0)
            if not len(go):
                break
            to = then[go]
            last[go], steps[go], then[go] = last[to], steps[go] + steps[to], then[to]
        yield from pa.table({"u": block["u"].combine_chunks(), "node": node, "at": up.take(pa.array(last)), "steps": steps}).to_batches(1 << 14)


#: Versions that starts can reach, counted for all that are followed together. Paths are as long as the way, so both limits are smaller with them.
REACH = 1 << 20


def _climber(aimed: bool, most: int, reach: int, paths: bool):
    """What a task does with rows ``uuid, node, other, way, own, a, b`` in order of uuid: edges, and starts, which alone have ``own``;
    ``a, b`` are the keys of node and other. Histories of less than ``most`` rows are followed, starts by as many as can reach ``reach`` versions; starts of others come back as long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, long = [], 0, None

        def left(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.filter(pc.is_valid(rows["own"]))
            yield from _reached(rows, np.zeros(len(rows), np.int32), pa.array([""] * len(rows), pa.string()), rows["node"], True)

        for batch in batches:
            if long is not None:
                same = pc.equal(batch["uuid"], long)
                yield from left(pa.Table.from_batches([batch.filter(same)]))
                batch = batch.filter(pc.invert(same))
                long = None if batch.num_rows else long
            held, n = [*held, batch], n + batch.num_rows
            if n < most:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            last = rows["uuid"][-1]
            whole = pc.index(rows["uuid"], last).as_py()
            yield from _follow_starts(rows.slice(0, whole), aimed, paths, reach)
            rest = rows.slice(whole)
            if len(rest) >= most:
                yield from left(rest)
                held, n, long = [], 0, last
            else:
                held, n = rest.to_batches(), len(rest)
        if n:
            yield from _follow_starts(pa.Table.from_batches(held).combine_chunks(), aimed, paths, reach)

    return run


def _reached(starts: pa.Table, depth: np.ndarray, path: pa.Array, node, long: bool) -> Iterator[pa.RecordBatch]:
    out = {"uuid": starts["uuid"], "own": starts["own"], "node": node, "depth": pa.array(depth, pa.int32()), "path": path, "long": pa.array(np.full(len(depth), long))}
    yield from pa.table(out).combine_chunks().to_batches(1 << 14)


def _follow_starts(rows: pa.Table, aimed: bool, paths: bool, reach: int) -> Iterator[pa.RecordBatch]:
    """What the starts reach by the edges of whole histories, breadth first, many starts at once."""
    start = pc.is_valid(rows["own"]).to_numpy()
    if not start.any():
        return
    # versions by numbers, those of a history together
    m = len(rows)
    code = pa.chunked_array([*rows["a"].chunks, *rows["b"].chunks]).combine_chunks().dictionary_encode()
    ids = pc.fill_null(code.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    file = rows["uuid"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    of, total = np.zeros(len(code.dictionary), np.int64), len(code.dictionary)
    seen = ids >= 0
    of[ids[seen]] = np.concatenate([file, file])[seen]
    number = np.empty(total, np.int64)
    number[np.argsort(of, kind="stable")] = np.arange(total)
    ids[seen] = number[ids[seen]]
    a, b, counts = ids[:m], ids[m:], np.bincount(of, minlength=file[-1] + 1)
    base = np.cumsum(counts) - counts
    edge = np.flatnonzero(~start)
    edge = edge[np.argsort(a[edge], kind="stable")]
    at = np.searchsorted(a[edge], np.arange(total + 1))
    up, way = b[edge], rows["way"].to_numpy()[edge]
    name = np.full(total, -1, np.int64)
    name[up] = edge
    asks = np.flatnonzero(start)
    room = np.cumsum(counts[file[asks]])
    for some in np.split(asks, np.flatnonzero(np.diff(room // reach)) + 1):
        slot = np.cumsum(counts[file[some]]) - counts[file[some]] - base[file[some]]
        met = np.zeros(counts[file[some]].sum(), bool)
        s, v, rank, path = np.arange(len(some)), a[some], np.zeros(len(some), np.int64), pa.array([""] * len(some), pa.string())
        met[slot[s] + v] = True
        found, depth = [(s, v, path)], 0
        while len(s):
            if aimed:
                go = np.flatnonzero(v != b[some][s])
                s, v, rank, path = s[go], v[go], rank[go], path.take(pa.array(go)) if paths else None
            n = at[v + 1] - at[v]
            back = np.repeat(np.arange(len(s)), n)
            e = np.arange(len(back)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[v], n)
            ns, nv, order = s[back], up[e], rank[back] * 10 + way[e]
            new = np.flatnonzero(~met[slot[ns] + nv])
            new = new[np.lexsort((order[new], slot[ns[new]] + nv[new]))]
            spot = slot[ns[new]] + nv[new]
            new = new[np.flatnonzero(np.diff(spot, prepend=-1))]
            met[slot[ns[new]] + nv[new]] = True
            if paths:
                path = pc.binary_join_element_wise(path.take(pa.array(back[new])), pa.array(way[e[new]]).cast(pa.string()), "")
            s, v, rank = ns[new], nv[new], np.unique(order[new], return_inverse=True)[1]
            found.append((s, v, path))
        deep = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
        s, v = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        path = pa.concat_arrays([x[2] for x in found]) if paths else pa.array([""] * len(s), pa.string())
        if aimed:
            hit = v == b[some][s]
            done = np.zeros(len(some), bool)
            done[s[hit]] = True
            keep = np.flatnonzero(hit | ~done[s])
            s, v, deep, path = s[keep], v[keep], deep[keep], path.take(pa.array(keep))
        named = pc.if_else(pa.array(deep == 0), rows["node"].combine_chunks().take(pa.array(some[s])), rows["other"].combine_chunks().take(pa.array(np.where(deep == 0, some[s], name[v]))))
        yield from _reached(rows.take(pa.array(some[s])), deep.astype(np.int32), path, named, False)


def place_runs(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``u, node, run, place`` of the versions of ``edges`` (those of plain_edges, saved) that are not the oldest of their run, whose key is ``run``.

    A task first follows edges as far as those that it holds lead; as they are dealt by uuid, that is all the way but for long
    histories. Then each round doubles the stretches that are known, so what is left of a run takes log2 rounds; a version that
    has no row, as the oldest ones, ends a stretch. ``u`` is the uuid's hash.
    """
    lone = edges.filter("lone").select(F.xxhash64("uuid").alias("u"), "node", "up").mapInArrow(_follow, "u bigint, node binary, at binary, steps bigint")
    state = scratch.save(lone.withColumn("done", F.lit(False)), "round-0")
    settled, going, waiting, step = [], state, state.count(), 0
    while waiting:
        every = reduce(lambda a, b: a.unionByName(b), [*settled, going])
        there = every.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("steps").alias("more"), F.col("done").alias("reached"))
        onward = going.join(there, "at", "left").select("u", "node", F.coalesce("to", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("reached", F.lit(True)).alias("done"))
        step += 1
        state = scratch.save(onward, f"round-{step}")
        settled.append(state.filter("done"))
        going = state.filter("not done")
        left = going.count()
        if left == waiting:  # rings, whose versions are a run each
            break
        waiting = left
    every = reduce(lambda a, b: a.unionByName(b), settled) if settled else state
    return every.select("u", "node", F.col("at").alias("run"), F.col("steps").alias("place"))


@dataclass
class Runs:
    """Histories by keys: a run is a longest row of versions, each the only child of its only parent."""

    #: ``node, run, place`` of versions that are not the oldest of their run.
    placed: DataFrame
    #: ``run, up, branch, top``: runs, those that they go on in, and the place there.
    links: DataFrame
    #: ``node, up, branch, name``: all edges, with the parent's name.
    parents: DataFrame


def runs_of(scratch: Scratch, history: DataFrame, uuids: DataFrame) -> Runs:
    """Runs of the files asked about, from edges or from versions that are placed."""
    some = uuids.select("uuid").distinct()
    if "run" in history.columns:
        at = history.select("uuid", version_key("uuid", "hash").alias("node"), version_key("uuid", "run").alias("run"), "place", "parents")
        first = at.filter("place = 0 and size(parents) > 0").select("uuid", "run", F.explode("parents").alias("p")).join(some, "uuid", "left_semi")
        links = first.select("run", version_key("uuid", "p.run").alias("up"), "p.branch", F.col("p.place").alias("top"))
        parents = at.select("uuid", "node", F.explode("parents").alias("p")).select("node", version_key("uuid", "p.hash").alias("up"), "p.branch", F.col("p.hash").alias("name"))
        return Runs(at.filter("place > 0").select("node", "run", "place"), scratch.save(links, "links"), parents)
    own = history.join(some, "uuid", "left_semi")
    parents = scratch.save(plain_edges(own).select("uuid", "node", "up", "lone", "branch", F.col("parent").alias("name")), "edges", "zstd")
    placed = place_runs(scratch, parents).drop("u")
    outer = parents.select(F.col("node").alias("run"), F.col("up").alias("node"), "branch").join(placed.select(F.col("node").alias("run")), "run", "left_anti")
    at = outer.join(placed.withColumnRenamed("run", "to"), "node", "left")
    return Runs(placed, scratch.save(at.select("run", F.coalesce("to", "node").alias("up"), "branch", F.coalesce("place", F.lit(0)).cast("bigint").alias("top")), "links"), parents)


def _at(rows: DataFrame, placed: DataFrame, of: str, run: str, place: str) -> DataFrame:
    """Rows with the run and place of the version ``of``; one that has no place is the oldest of its own."""
    x = rows.join(placed.select(F.col("node").alias(of), F.col("run").alias("_run"), F.col("place").alias("_place")), of, "left")
    return x.select(*(c for c in rows.columns if c != of), F.coalesce("_run", of).alias(run), F.coalesce("_place", F.lit(0)).alias(place))


def descends(pairs: DataFrame, history: DataFrame) -> DataFrame:
    """``pairs`` (uuid, hash, ancestor, prev, prev2, ...) with ``descends``: the ancestor is the version, a seed, or reached from one.

    A null ancestor is no one's. Only pairs that their own columns do not answer are looked up in the history, edges or
    placed versions: two places of one run are compared, and links between runs are climbed, once for all that ask the same.
    An ancestor that no edge knows is met only by its own name.
    """
    own = F.filter(F.array("hash", "prev", "prev2"), lambda x: x.isNotNull())
    here = F.col("ancestor").isNotNull() & F.array_contains(own, F.col("ancestor"))
    scratch = within(pairs.sparkSession, "descends")
    open_ = F.col("ancestor").isNotNull() & ~F.coalesce(here, F.lit(False)) & F.col("uuid").isNotNull()
    asked = scratch.save(pairs.withColumns({"_id": F.monotonically_increasing_id(), "_here": F.coalesce(here, F.lit(False)), "_open": open_}), "asked", "zstd")
    rest = asked.filter("not _open").select(*pairs.columns, F.col("_here").alias("descends"))
    unknown = asked.filter("_open")
    if unknown.isEmpty():
        return rest
    runs = runs_of(scratch, history, unknown)
    starts = unknown.select("_id", version_key("uuid", "ancestor").alias("goal"), F.explode(F.transform(F.array_distinct(own), lambda x: version_key(F.col("uuid"), x))).alias("node"))
    x = _at(_at(starts, runs.placed, "node", "run", "place"), runs.placed, "goal", "goal", "low")
    direct = (F.col("run") == F.col("goal")) & (F.col("place") >= F.col("low"))
    if runs.links.isEmpty():
        found = x.filter(direct).select("_id")
    else:
        x = scratch.save(x, "at")
        apart = x.filter(~direct)
        begin = apart.select("run", F.col("goal").alias("target")).distinct().join(runs.links.select("run", F.col("up").alias("node")), "run").distinct()
        met = _climb(scratch, begin.withColumns({"depth": F.lit(0), "path": F.lit("")}), _ways(runs, F.lit(1))).filter("node = target").select("run", F.col("target").alias("goal")).distinct()
        found = x.filter(direct).select("_id").unionByName(apart.join(met, ["run", "goal"], "left_semi").select("_id"))
    joined = unknown.join(found.distinct().withColumn("_met", F.lit(True)), "_id", "left")
    return rest.unionByName(joined.select(*pairs.columns, F.coalesce("_met", F.lit(False)).alias("descends")))


def _ways(runs: Runs, cost: Column) -> DataFrame:
    return runs.links.select(F.col("run").alias("node"), "up", F.col("branch").cast("string").alias("way"), cost.alias("cost"))


def common_ancestor(pairs: DataFrame, history: DataFrame) -> DataFrame:
    """``pairs`` (uuid, left, right) with ``base``: of the versions that both come from, the first that left meets, going back.

    Of two versions of one run it is the first parent of the lower one. For others, links between runs are climbed once a
    run, for all versions in it. Two versions that both come from some of a run both come from its lower part, whose
    newest is the nearest: so a question takes a row for each run that both reach.
    """
    scratch = within(pairs.sparkSession, "common")
    asked = scratch.save(pairs.withColumn("_id", F.monotonically_increasing_id()), "asked", "zstd")
    runs = runs_of(scratch, history, asked.filter("left is not null and right is not null"))
    ask = asked.select("_id", version_key("uuid", "left").alias("left"), version_key("uuid", "right").alias("right")).filter("left is not null and right is not null")
    keys = ask.withColumns({"a": F.col("left"), "b": F.col("right")})
    x = _at(_at(keys, runs.placed, "a", "left_run", "left_place"), runs.placed, "b", "right_run", "right_place")
    split = not runs.links.isEmpty()
    x = scratch.save(x, "at") if split else x
    lower = x.filter("left_run = right_run").select("_id", F.when(F.col("left_place") <= F.col("right_place"), F.col("left")).otherwise(F.col("right")).alias("node"))
    first = runs.parents.groupBy("node").agg(F.min_by("name", F.struct("branch", "up")).alias("base"))
    found = lower.join(first, "node").select("_id", "base")
    if split:
        found = found.unionByName(_across(scratch, x.filter("left_run <> right_run"), runs))
    rest = [c for c in pairs.columns if c not in ("uuid", "left", "right")]
    return asked.join(found, "_id", "left").select("uuid", "left", "right", *rest, "base")


def _across(scratch: Scratch, asked: DataFrame, runs: Runs) -> DataFrame:
    """``_id, base`` of questions about versions of two runs."""
    tops = runs.links.select(F.col("up").alias("node"), "top").distinct()
    of = lambda side: asked.select(F.col(f"{side}_run").alias("run"))
    begin = of("left").union(of("right")).distinct().join(runs.links, "run").groupBy("run", "up").agg(F.min(F.struct((F.col("top") + 1).alias("depth"), F.col("branch").cast("string").alias("path"))).alias("r"))
    far = _climb(scratch, begin.select("run", F.col("up").alias("node"), "r.*"), _ways(runs, F.col("top") + 1)).join(tops, "node").select("run", F.col("node").alias("to"), "top", "depth", "path")

    def reach(side: str) -> DataFrame:
        at = asked.select("_id", F.col(f"{side}_run").alias("run"), F.col(f"{side}_place").alias("place"))
        above = at.join(far, "run").select("_id", F.col("to").alias("run"), F.col("top").alias(side), (F.col("place") + F.col("depth")).alias("depth"), "path")
        return at.filter("place > 0").select("_id", "run", (F.col("place") - 1).alias(side), F.col("place").alias("depth"), F.lit("").alias("path")).unionByName(above)

    place = F.least("left", "right")
    both = reach("left").join(reach("right").drop("depth", "path"), ["_id", "run"]).groupBy("_id").agg(F.min_by(F.struct("run", place.alias("place")), F.struct(F.col("depth") - place, "path", "run")).alias("b")).select("_id", "b.*")
    named = both.join(runs.placed, ["run", "place"], "left").select("_id", F.coalesce("node", "run").alias("node"))
    return named.join(runs.parents.select(F.col("up").alias("node"), F.col("name").alias("base")).dropDuplicates(["node"]), "node").select("_id", "base")


def moved_from(pairs: DataFrame, moves: DataFrame) -> DataFrame:
    """``pairs`` (uuid, path, seed, target) with ``moved``: following moves back from seed, or else from path, meets target."""
    here = F.coalesce(F.col("seed") == F.col("target"), F.lit(False))
    starts = pairs.filter(~here).select("uuid", F.col("path").alias("_path"), "target", F.coalesce("seed", "path").alias("node"))
    met = climb(starts, moves.withColumnsRenamed({"path": "hash", "prev_path": "parent"}), paths=False).filter("node = target and depth > 0").select("uuid", F.col("_path").alias("path"), "target").distinct()
    return pairs.join(met.withColumn("_met", F.lit(True)), ["uuid", "path", "target"], "left").withColumn("moved", here | F.coalesce("_met", F.lit(False))).drop("_met")
