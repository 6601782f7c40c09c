"""The operation log as a set of immutable rows keyed by ``op``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import op_id, xor_digest
from ..functions.paths import extension


def with_op(rows: DataFrame) -> DataFrame:
    return rows.withColumn("op", op_id(F.col("peer"), F.col("uuid"), F.col("at_ms"), F.col("type"), F.col("path"), F.col("hash")))


def union_rows(*logs: DataFrame) -> DataFrame:
    """One row an op; of rows with one op, that of the first log given."""
    ranked = [log.withColumn("_rank", F.lit(i)) for i, log in enumerate(logs)]
    every = reduce(lambda a, b: a.unionByName(b), ranked)
    columns = [c for c in every.columns if c not in ("op", "_rank")]
    first = F.min_by(F.struct(*columns), F.col("_rank"))
    return every.groupBy("op").agg(first.alias("r")).select("op", *(F.col(f"r.{c}") for c in columns))


def missing_rows(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose op is not there yet, each once."""
    return incoming.dropDuplicates(["op"]).join(existing.select("op"), "op", "left_anti")


def append_rows(log: DataFrame, rows: DataFrame, segment: int) -> DataFrame:
    """The log with the rows that it lacks, in its open segment; all rows of one append have the next ``seq`` of the segment."""
    number = log.filter(F.col("segment") == segment).agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).cast("bigint").alias("seq"))  # one row
    fresh = missing_rows(log, rows.drop("segment", "seq")).withColumn("segment", F.lit(segment).cast("bigint")).crossJoin(F.broadcast(number))
    return log.unionByName(fresh, allowMissingColumns=True)


def open_mark(log: DataFrame, segment: int) -> DataFrame:
    """One row: how far the open segment goes, ``segment, seq, rows, digest``."""
    own = log.filter(F.col("segment") == segment)
    return own.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("bigint").alias("seq"), F.count(F.lit(1)).alias("rows"), xor_digest(F.col("op")).alias("digest")).select(F.lit(segment).cast("bigint").alias("segment"), "seq", "rows", "digest")


def peer_log(log: DataFrame, segment: int, mark: tuple[int, int] | None) -> DataFrame:
    """A peer's open segment from where a mark (segment, seq) ends; all of it where the peer has begun another since."""
    own = log.filter(F.col("segment") == segment)
    return own.filter(F.col("seq") > mark[1]) if mark is not None and mark[0] == segment else own


def upsert_mark(marks: DataFrame, peer: str, at_ms: int, mark: DataFrame) -> DataFrame:
    """Marks ``peer, last_sync, segment, seq, digest`` with that of one peer renewed."""
    own = mark.select(F.lit(peer).alias("peer"), F.lit(at_ms).cast("bigint").alias("last_sync"), "segment", "seq", "digest")
    return marks.filter(F.col("peer") != peer).select(*own.columns).unionByName(own)


def sort_rows(log: DataFrame) -> DataFrame:
    return log.orderBy("at_ms", "op")


def recent(log: DataFrame, most: int = 100) -> DataFrame:
    """The last operations, newest first."""
    return log.orderBy(F.desc("at_ms"), F.desc("op")).limit(most)


def log_mark(log: DataFrame, *by: str) -> DataFrame:
    """Rows and set digest, by the columns given."""
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), xor_digest(F.col("op")).alias("digest"))


def latest(log: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """The last record of each uuid by time: ``uuid, last_ms, last_deleted, last_path``; of one time, the one fed later (entries, then order)."""
    rows = log.select("uuid", F.col("at_ms").alias("t"), (F.col("type") == "delete").alias("deleted"), "path", F.lit(0).alias("source"), F.col("op").alias("tie"))
    if entries is not None:
        rows = rows.unionByName(entries.select("uuid", F.col("updated").alias("t"), "deleted", "path", F.lit(1).alias("source"), F.col("uuid").alias("tie")))
    last = F.max_by(F.struct("t", "deleted", "path"), F.struct("t", "source", "tie"))
    return rows.groupBy("uuid").agg(last.alias("r")).select("uuid", F.col("r.t").alias("last_ms"), F.col("r.deleted").alias("last_deleted"), F.col("r.path").alias("last_path"))


def cumulative_snapshot(before: DataFrame, now: DataFrame) -> DataFrame:
    """The row of each uuid with the higher ``updated``, now winning ties; tombstones stay."""
    both = before.withColumn("_now", F.lit(0)).unionByName(now.withColumn("_now", F.lit(1)))
    columns = [c for c in before.columns if c != "uuid"]
    return both.groupBy("uuid").agg(F.max_by(F.struct(*columns), F.struct("updated", "_now")).alias("r")).select("uuid", *(F.col(f"r.{c}") for c in columns))


def segments(log: DataFrame) -> DataFrame:
    """Rows, digest and the span of time of each segment, by which reads of closed segments are pruned."""
    return log.groupBy("segment").agg(
        F.count(F.lit(1)).alias("rows"), F.min("at_ms").alias("min_at"), F.max("at_ms").alias("max_at"), xor_digest(F.col("op")).alias("digest"))


def archives_since(log: DataFrame, since_ms: int) -> DataFrame:
    """Rows of the segments that reach to a moment or beyond."""
    reach = segments(log).filter(F.col("max_at") >= since_ms).select("segment")
    return log.join(reach, "segment", "left_semi")


def file_history(log: DataFrame) -> DataFrame:
    """Each row with its number in its file's history, by time."""
    return log.withColumn("version", F.row_number().over(Window.partitionBy("uuid").orderBy("at_ms", "op")))


def batch_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def should_rotate(log: DataFrame, limit: int) -> DataFrame:
    """Whether the encoded rows of each segment exceed the limit in bytes."""
    width = F.octet_length(F.to_json(F.struct(*log.columns))) + 1
    return log.groupBy("segment").agg(F.sum(width).cast("bigint").alias("bytes")).withColumn("rotate", F.col("bytes") > limit)


def prune_tombstones(entries: DataFrame, log: DataFrame, marks: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Entries without tombstones that every peer has seen and that the log or the snapshot can prove; with no peer, all stay."""
    provable = log.filter("type = 'delete'").select("uuid")
    if snapshot is not None:
        provable = provable.union(snapshot.filter("deleted").select("uuid"))
    floor = marks.agg(F.min("last_sync").alias("floor"))  # one row
    gone = entries.crossJoin(F.broadcast(floor)).filter(F.col("deleted") & (F.col("updated") < F.col("floor"))).select("uuid")
    return entries.join(gone.join(provable.distinct(), "uuid", "left_semi"), "uuid", "left_anti")


def kept_texts(entries: DataFrame, before: DataFrame, contents: DataFrame, bases: DataFrame, text: tuple[str, ...], largest: int, cap: int) -> DataFrame:
    """Texts by hash, ``hash, text, mtime``, that later merges can start from.

    The texts of new versions are added; then only the versions stay that an entry or its parents name, the newest ``cap``
    of them. Without a new version nothing changes.
    """
    own = entries.filter(~F.col("deleted") & (F.col("kind") == "file") & F.col("hash").isNotNull() & extension(F.col("path")).isin(*text))
    was = before.select("uuid", F.col("hash").alias("_was"))
    new = own.join(was, "uuid", "left").filter((F.col("size") <= largest) & ~F.col("hash").eqNullSafe(F.col("_was"))).groupBy("hash").agg(F.max("updated").alias("mtime"))
    written = new.join(contents.select("hash", "text").dropDuplicates(["hash"]), "hash").select("hash", "text", "mtime")
    if written.isEmpty():
        return bases
    named = own.select(F.explode(F.array("hash", "prev", "prev2")).alias("hash")).filter("hash is not null").distinct()
    every = written.unionByName(bases.join(written.select("hash"), "hash", "left_anti").select("hash", "text", "mtime"))
    return newest_bases(every.join(named, "hash", "left_semi").withColumn("store", F.lit("")), cap).drop("store")


def newest_bases(bases: DataFrame, cap: int) -> DataFrame:
    """The newest ``cap`` text versions of each store."""
    place = F.row_number().over(Window.partitionBy("store").orderBy(F.desc("mtime"), "hash"))
    return bases.withColumn("_place", place).filter(F.col("_place") <= cap).drop("_place")
