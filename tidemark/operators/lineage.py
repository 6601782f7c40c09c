"""Histories as runs: what descends from what is told by places in them, and only branches and merges are climbed.

A run is a longest row of versions, each the only child of its only parent. A version stands at a place in one run,
counted from the oldest. Runs hang together by links: from a run's oldest version to its parents, each of which is the
newest of its own run. So a history that was never changed on two sides is one run, and a question about it is a
comparison of two places, however long it is; otherwise runs are climbed, once for all versions that stand in them.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import within
from . import ancestry

PARENT = "struct<branch:int,hash:string,run:string,place:bigint>"
VERSION = ("uuid", "hash", "run", "place", "parents")
VERSIONS = f"uuid string, hash string, run string, place bigint, parents array<{PARENT}>"


def runs(edges: DataFrame, below: DataFrame | None = None) -> DataFrame:
    """VERSIONS of ``edges`` (uuid, hash, parent, branch), those that are only named as parents included.

    ``below`` (uuid, hash, run, place) are versions that have their place already and no child but those in ``edges``;
    runs go on from them, and they are not returned. Rounds move keys; names move once, to what they settle. Versions of a
    ring, which no true history has, are a run each.
    """
    scratch = within(edges.sparkSession, "runs")
    edge = scratch.save(ancestry.plain_edges(edges), "edges", "zstd")
    out = scratch.save(_versions(edge, ancestry.place_runs(scratch, edge), below).select(*VERSION), "result", "zstd")
    scratch.drop(*(n for n in list(scratch.names) if n != "result"))
    return out


def _versions(edge: DataFrame, placed: DataFrame, below: DataFrame | None) -> DataFrame:
    """VERSIONS, and the greatest ``turn`` of their edges where they have one, by edges, places in runs and versions that are placed already.

    Names move once, dealt by uuid: what follows goes by uuid and version, uuid and run, so all of it is at hand.
    """
    u = F.xxhash64("uuid").alias("u")
    parts = [edge.select(u, "uuid", "node", "hash", "up", "parent", "branch", *(["turn"] if "turn" in edge.columns else [])), placed]
    if below is not None:
        parts.append(below.select(u, ancestry.version_key("uuid", "hash").alias("node"), F.col("run").alias("base"), F.col("place").alias("from")))
    columns = {"u": "bigint", "uuid": "string", "node": "binary", "hash": "string", "up": "binary", "parent": "string", "branch": "int", "turn": "bigint", "run": "binary", "place": "bigint", "base": "string", "from": "bigint"}
    every = reduce(lambda a, b: a.unionByName(b), (p.select(*((F.col(c) if c in p.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items())) for p in parts))
    link = F.struct("branch", F.col("parent").alias("hash"), "up")
    rest = [F.col(c) for c in ("run", "place", "base", "from")]
    ends = F.when(F.col("up").isNotNull(), F.array(F.struct("node", "hash", link.alias("p"), *rest), F.struct(F.col("up").alias("node"), F.col("parent").alias("hash"), F.lit(None).cast("struct<branch:int,hash:string,up:binary>").alias("p"), *rest)))
    ends = ends.otherwise(F.array(F.struct("node", "hash", F.lit(None).cast("struct<branch:int,hash:string,up:binary>").alias("p"), *rest)))
    named = every.repartition("u").select("u", "uuid", "turn", F.explode(ends).alias("e")).select("u", "uuid", "turn", "e.*")
    rows = named.groupBy("u", "node").agg(*(F.max(c).alias(c) for c in ("uuid", "hash", "turn", "run", "place", "base", "from")), F.array_sort(F.collect_list("p")).alias("p"))
    # the oldest of each run gives its name and, where it goes on from a place that is known, that one
    rows = rows.withColumn("run", F.coalesce("run", "node"))
    own, run = F.col("place").isNull(), Window.partitionBy("u", "run")
    rows = rows.withColumns({"name": F.max(F.when(own, F.coalesce("base", "hash"))).over(run), "at": F.coalesce("place", F.lit(0)) + F.max(F.when(own, F.coalesce("from", F.lit(0)))).over(run)})
    # links from the oldest go to where their parents stand
    itself = F.struct("node", "uuid", "hash", "turn", "name", "at", "base", F.when(~own, F.col("p")[0]).alias("p")).alias("v")
    here = F.array(F.struct(F.col("node").alias("to"), F.col("node").alias("of"), itself, F.lit(None).cast("struct<branch:int,hash:string,up:binary>").alias("p")))
    outer = F.transform(F.when(own, F.col("p")).otherwise(F.slice("p", 1, 0)), lambda p: F.struct(p["up"].alias("to"), F.col("node").alias("of"), F.lit(None).cast(_type(rows.select(itself))).alias("v"), p.alias("p")))
    met = rows.select("u", F.explode(F.concat(here, outer)).alias("e")).select("u", "e.*")
    stands = F.max(F.struct(F.col("v.name").alias("name"), F.col("v.at").alias("at"))).over(Window.partitionBy("u", "to"))
    met = met.withColumn("s", stands)
    parent = lambda p, run, place: F.struct(p["branch"].alias("branch"), p["hash"].alias("hash"), run.alias("run"), place.alias("place"))
    out = met.groupBy("u", "of").agg(F.first("v", ignorenulls=True).alias("v"), F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), parent(F.col("p"), F.col("s.name"), F.col("s.at"))))).alias("links"))
    inner = F.array(parent(F.col("v.p"), F.col("v.name"), F.col("v.at") - 1))
    out = out.filter("v.base is null").select("v.uuid", "v.hash", F.col("v.name").alias("run"), F.col("v.at").alias("place"), F.when(F.col("v.p").isNotNull(), inner).otherwise(F.col("links")).cast(f"array<{PARENT}>").alias("parents"), "v.turn")
    return out


def _type(one: DataFrame):
    return one.schema[0].dataType


def links(versions: DataFrame) -> DataFrame:
    """``uuid, hash, parent, branch, cost, top``: runs, the runs that they go on in, how far the oldest version of one is from that of the other."""
    p = versions.filter("place = 0").select("uuid", "run", F.explode("parents").alias("p"))
    return p.select("uuid", F.col("run").alias("hash"), F.col("p.run").alias("parent"), "p.branch", (F.col("p.place") + 1).alias("cost"), F.col("p.place").alias("top"))


def descends(pairs: DataFrame, versions: DataFrame) -> DataFrame:
    """``pairs`` (uuid, hash, ancestor, prev, prev2, ...) with ``descends``, by the runs of the versions, or of edges in their place."""
    return ancestry.descends(pairs, versions)


def common_ancestor(pairs: DataFrame, versions: DataFrame) -> DataFrame:
    """``pairs`` (uuid, left, right) with ``base``, by the runs of the versions, or of edges in their place."""
    return ancestry.common_ancestor(pairs, versions)


@dataclass
class Lineage:
    """Runs that are kept in a folder and grow with the log. One session writes; its threads take turns.

    Rows are only added. Where new versions go on from newest ones, or merge them, theirs are all there is to add; a uuid
    whose known versions get another child or parent is placed anew under a greater ``turn``, and the greatest counts.
    An append is one write, so it is there or not; said twice, it adds nothing.
    """

    spark: SparkSession
    folder: str
    _turn: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def _rows(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        schema = VERSIONS + ", turn bigint"
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.folder)

    def versions(self, uuids: DataFrame | None = None) -> DataFrame:
        """VERSIONS and turn, of all or of some uuids."""
        rows = self._rows() if uuids is None else self._rows().join(uuids.select("uuid").distinct(), "uuid", "left_semi")
        return rows.withColumn("last", F.max("turn").over(Window.partitionBy("uuid"))).filter("turn = last").drop("last")

    def append(self, edges: DataFrame) -> int:
        """Add what edges say that is not known; the number of rows written."""
        with self._turn:
            return self._append(edges)

    def _append(self, edges: DataFrame) -> int:
        scratch = within(self.spark, "lineage")
        rows = self._rows()
        if rows.isEmpty():
            table = ancestry.plain_edges(edges).withColumn("turn", F.lit(0).cast("bigint"))
            edge, below = scratch.save(table, "edges", "zstd"), None
        else:
            table = scratch.save(self._changes(scratch.save(ancestry.once(edges), "given", "zstd"), rows), "edges", "zstd")
            edge, below = table.filter("not marker"), table.filter("marker").select("uuid", "hash", "run", "place")
        if edge.isEmpty():
            scratch.clear()
            return 0
        placed = ancestry.place_runs(scratch, edge)
        seen = Observation()
        new = _versions(edge, placed, below).sortWithinPartitions("uuid", "run", "place").observe(seen, F.count(F.lit(1)).alias("n"))
        new.write.mode("append").parquet(self.folder, compression="zstd")
        scratch.clear()
        return seen.get["n"]

    def _changes(self, given: DataFrame, rows: DataFrame) -> DataFrame:
        """Edges to place, as plain_edges has them, with their turn: new ones, and all of a uuid that is placed anew; and as
        markers (hash is parent) the versions with run and place that new ones go on from.

        Edges and what is known of their uuids are dealt by uuid once, and all that is asked of them goes by uuid.
        """
        item = lambda parent, branch, run, place, marker, known: F.struct(F.col("hash"), parent.alias("parent"), branch.cast("int").alias("branch"), run.cast("string").alias("run"), place.cast("bigint").alias("place"), marker.alias("marker"), known.alias("known"))
        no, yes, none = F.lit(False), F.lit(True), F.lit(None)
        old = rows.join(given.select("uuid").distinct(), "uuid", "left_semi")
        every = old.select("uuid", "hash", "run", "place", "parents", "turn").unionByName(given.select("uuid", "hash", "parent", "branch"), allowMissingColumns=True).repartition("uuid")
        uuid = Window.partitionBy("uuid")
        every = every.withColumn("last", F.max("turn").over(uuid)).filter("turn is null or turn = last")
        told = F.concat(F.array(item(F.col("hash"), none, F.col("run"), F.col("place"), yes, yes)), F.transform("parents", lambda p: item(p["hash"], p["branch"], none, none, no, yes)))
        items = every.select("uuid", "last", F.explode(F.when(F.col("turn").isNotNull(), told).otherwise(F.array(item(F.col("parent"), F.col("branch"), none, none, no, no)))).alias("e")).select("uuid", "last", "e.*")
        branch = F.coalesce(F.min(F.when(F.col("known"), F.col("branch"))), F.min("branch")).alias("branch")
        items = items.groupBy("uuid", "hash", "parent").agg(F.max("last").alias("last"), branch, F.max("run").alias("run"), F.max("place").alias("place"), F.max("marker").alias("marker"), (~F.max("known")).alias("fresh"))
        down, up = Window.partitionBy("uuid", "hash"), Window.partitionBy("uuid", "parent")
        items = items.withColumn("known_hash", F.max("marker").over(down))
        items = items.withColumns({"known_parent": F.max("marker").over(up), "children": F.sum((~F.col("marker")).cast("int")).over(up), "goes_on": F.max("fresh").over(up)})
        anew = F.col("fresh") & (F.col("known_hash") | F.col("known_parent") & (F.col("children") > 1))
        items = items.withColumn("again", F.max(anew).over(uuid))
        items = items.filter("case when marker then goes_on and not again else fresh or again end")
        n = lambda end: F.sum((~F.col("marker")).cast("int")).over(end) == 1
        items = items.withColumn("lone", n(down)).withColumn("lone", n(up) & F.col("lone") & ~F.col("marker"))
        turn = F.coalesce("last", F.lit(0)) + F.col("again").cast("bigint")
        return items.select("uuid", "hash", "parent", "branch", "lone", turn.alias("turn"), "marker", "run", "place", ancestry.version_key("uuid", "hash").alias("node"), ancestry.version_key("uuid", "parent").alias("up"))
