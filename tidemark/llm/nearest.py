"""Approximate nearest neighbours by cosine: one navigable small-world graph a shard, results merged.

Equal vectors are indexed once, with the smallest ids of theirs that any result can need. The distinct
vectors are dealt into shards of bounded size by a hash. A task builds a shard's hierarchical graph:
each vector gets a level of geometric distribution, and links to diverse near vectors on each level. A shard
is stored as one row of flat arrays: ids, vectors, levels, and for each level a table of neighbour numbers.
Queries are packed into blocks of bounded size, every block meets every shard, and the best of all shards
are merged. Nearness is worked out anew in double precision on the original vectors.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, parallelism

LINKS, BREADTH_BUILD, BREADTH_SEARCH = 12, 64, 96
#: Blocks of queries that one task takes through a shard.
BLOCKS = 8
SHARD_ROWS = (4000, 200_000)


class Graph:
    """A hierarchical navigable small-world graph over unit vectors; neighbours in flat arrays, -1 for none."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray | None = None, tables: list[np.ndarray] | None = None, entry: int = 0) -> None:
        self.v, self.entry = vectors, entry
        n = len(vectors)
        if levels is None:
            rng = np.random.default_rng(n)
            levels = np.minimum((-np.log(rng.random(n)) / np.log(LINKS)).astype(np.int32), 8)
        self.levels = levels
        if tables is None:
            self.tables = [np.full((n, 2 * LINKS if i == 0 else LINKS), -1, np.int32) for i in range(int(levels.max(initial=0)) + 1)]
            self.size = [np.zeros(n, np.int32) for _ in self.tables]
            self._build()
        else:
            self.tables = tables
            self.size = [(t >= 0).sum(axis=1).astype(np.int32) for t in tables]

    def near(self, q: np.ndarray, start: list[tuple[float, int]], breadth: int, level: int) -> list[tuple[float, int]]:
        """The nearest found from given starts: (distance, number), nearest first."""
        table, size, v = self.tables[level], self.size[level], self.v
        seen = np.zeros(len(v), bool)
        seen[[i for _, i in start]] = True
        todo = list(start)
        heapq.heapify(todo)
        found = [(-d, i) for d, i in start]
        heapq.heapify(found)
        while todo:
            d, i = heapq.heappop(todo)
            if d > -found[0][0] and len(found) >= breadth:
                break
            near = table[i, : size[i]]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            away = 1.0 - v[near] @ q
            if len(found) >= breadth:
                close = away < -found[0][0]
                near, away = near[close], away[close]
            for x, j in zip(away.tolist(), near.tolist(), strict=True):
                if len(found) < breadth:
                    heapq.heappush(found, (-x, j))
                elif x < -found[0][0]:
                    heapq.heapreplace(found, (-x, j))
                else:
                    continue
                heapq.heappush(todo, (x, j))
        return sorted((-d, i) for d, i in found)

    def descend(self, q: np.ndarray, level: int) -> list[tuple[float, int]]:
        """The nearest found on the levels above one, from the entry point on."""
        best = [(1.0 - float(self.v[self.entry] @ q), self.entry)]
        for up in range(int(self.levels[self.entry]), level, -1):
            best = self.near(q, best, 1, up)[:1]
        return best

    def _diverse(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of the nearest, those that are nearer to the new vector than to any taken before; then the rest, as room allows."""
        if len(found) <= most:
            return [i for _, i in found]
        numbers = np.array([i for _, i in found])
        away = 1.0 - self.v[numbers] @ self.v[numbers].T
        taken: list[int] = []
        blocked = np.zeros(len(found), bool)
        own = np.array([d for d, _ in found])
        for k in range(len(found)):
            if not blocked[k]:
                taken.append(k)
                if len(taken) == most:
                    break
                blocked |= away[k] < own
        if len(taken) < most:
            rest = np.setdiff1d(np.arange(len(found)), taken)
            taken += rest[: most - len(taken)].tolist()
        return numbers[taken].tolist()

    def _build(self) -> None:
        top = -1
        for i in range(len(self.v)):
            q, level = self.v[i], int(self.levels[i])
            if top >= 0:
                best = self.descend(q, min(level, top))
                for at in range(min(level, top), -1, -1):
                    best = self.near(q, best, BREADTH_BUILD, at)
                    width = self.tables[at].shape[1]
                    for j in self._diverse(best, LINKS):
                        self._add(at, i, j, width)
                        self._add(at, j, i, width)
            if level > top:
                top, self.entry = level, i

    def _add(self, level: int, i: int, j: int, width: int) -> None:
        table, size = self.tables[level], self.size[level]
        if size[i] < width:
            table[i, size[i]] = j
            size[i] += 1
            return
        near = np.append(table[i], j)
        away = 1.0 - self.v[near] @ self.v[i]
        order = np.argsort(away, kind="stable")
        keep = self._diverse([(float(away[k]), int(near[k])) for k in order], width * 3 // 4)
        table[i] = -1
        table[i, : len(keep)] = keep
        size[i] = len(keep)

    def search(self, q: np.ndarray, k: int, breadth: int = BREADTH_SEARCH) -> list[int]:
        return [i for _, i in self.near(q, self.descend(q, 0), max(breadth, k), 0)[:k]]


def unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)).astype(np.float32)


def cosine(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """In double precision, component by component, so that equal vectors give equal values."""
    q, vectors = q.astype(float), vectors.astype(float)
    return (vectors * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((vectors * vectors).sum(axis=1)))


INDEX = "dim int, shard int, n int, ids binary, members array<array<bigint>>, vectors binary, levels binary, entry int, tables array<binary>"


def _build_shard(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    vectors = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
    g = Graph(unit(vectors))
    return pd.DataFrame([{
        "dim": key[0], "shard": key[1], "n": len(pdf), "ids": pdf["id"].to_numpy(np.int64).tobytes(), "members": list(pdf["members"]), "vectors": vectors.tobytes(),
        "levels": g.levels.tobytes(), "entry": g.entry, "tables": [t.tobytes() for t in g.tables]}])


def _search_shard(k: int, breadth: int):
    """Blocks of queries against one shard, whose graph is put together once."""

    def run(index: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        for r in index.itertuples(index=False):
            n = int(r.n)
            vectors = np.frombuffer(r.vectors, np.float64).reshape(n, -1)
            tables = [np.frombuffer(t, np.int32).reshape(n, -1) for t in r.tables]
            g = Graph(unit(vectors), np.frombuffer(r.levels, np.int32), tables, int(r.entry))
            for block in blocks.itertuples(index=False):
                queries = np.frombuffer(block.query_vectors, np.float64).reshape(-1, vectors.shape[1])
                for qid, q, u in zip(np.frombuffer(block.query_ids, np.int64).tolist(), queries, unit(queries), strict=True):
                    hit = g.search(u, k + 1, breadth)
                    for i, score in zip(hit, cosine(q, vectors[hit]), strict=True):
                        out += [(qid, int(m), float(score)) for m in r.members[i] if m != qid]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([{"dim": int(pdf["dim"].iloc[0]), "block": int(pdf["block"].iloc[0]), "query_ids": pdf["id"].to_numpy(np.int64).tobytes(), "query_vectors": np.stack(pdf["vector"].to_numpy()).astype(np.float64).tobytes()}])


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 5, shard_rows: int | None = None, block_rows: int = 2000, breadth: int = BREADTH_SEARCH) -> DataFrame:
    """For each row that ``queries`` holds for: ``query_id, rank, vec_id, score``, its k nearest other rows.

    Ties go to the smaller id. Rows with a null id, a null, empty or zero vector or one with null or
    non-finite components take no part. Vectors are compared with those of their own size. Rows that repeat
    count once; of several vectors under one id the smallest is the query's, and each is a candidate. Other columns are ignored; an empty table gives no rows. ``shard_rows`` and ``block_rows`` bound what a
    task holds; each block of queries meets each shard. By default there are two shards for each task that runs at once,
    of ``SHARD_ROWS`` at least and at most, so that a large table has few large graphs rather than many small ones.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("q"))
    sound = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.filter(F.col("id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).filter((sound > 0) & (sound < float("inf")))
    rows = rows.withColumn("dim", F.size("vector"))
    n = rows.count()
    if shard_rows is None:
        shard_rows = min(SHARD_ROWS[1], max(SHARD_ROWS[0], n // (2 * parallelism(spark))))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-rows.filter("q").count() // block_rows))
    # k + 1 members of a class of equal vectors are all that k results and the query itself can take
    ranked = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("place") <= k + 1)
    classes = ranked.groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("members")).select(F.col("members")[0].alias("id"), "members", "vector", F.size("vector").alias("dim"))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).repartitionByRange(shards, "dim", "shard")
    index = scratch.save(dealt.groupBy("dim", "shard").applyInPandas(_build_shard, INDEX), "index")
    asked = rows.filter("q").groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    packed = asked.groupBy("dim", "block").applyInPandas(_pack, "dim int, block int, query_ids binary, query_vectors binary")
    # a shard goes to as many tasks as there are parts, each of which puts it together once for its blocks
    parts, key = -(-blocks // BLOCKS), ["dim", "shard", "part"]
    sent = packed.withColumn("part", F.col("block") % parts).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    graphs = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = graphs.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(_search_shard(k, breadth), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scratch.last(found.distinct().withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
