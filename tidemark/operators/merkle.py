"""States that say where they differ: trees of digests over ranges of uuids, compared from the root down.

An entry belongs to the leaf that the first digits of its uuid's SHA-256 name, so leaves are even and a state of any size has
as many as it is given digits for. A node's digest is the XOR of its entries' digests: it combines map-side, and the
upper levels are sums over the leaves. Entries are stored by leaf, so that a comparison reads the leaves that differ and
no others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import entry_json, xor_digest, xor_hex
from ..plans.scratch import keep
from ..schema import ENTRIES
from .merge import entry_rows

#: Differing leaves that are named in a read; beyond, they are joined.
NAMED = 1000


@dataclass
class StoredState:
    """Live entries by leaf, and the tree over them: ``level, node, n, digest``, level 0 being the root, whose name is x."""

    entries: DataFrame
    tree: DataFrame
    digits: int


def leaf(digits: int):
    return F.concat(F.lit("x"), F.substring(F.sha2("uuid", 256), 1, digits))


def digested(entries: DataFrame) -> DataFrame:
    """Live entries with ``own``, the digest of what states agree on."""
    full = entry_rows(entries).filter("not deleted")
    return full.withColumn("own", F.sha2(entry_json(*(F.col(c) for c in ("kind", "path", "hash", "size", "updated", "uuid"))), 256))


def tree_of(leaves: DataFrame, digits: int) -> DataFrame:
    """All levels from rows ``leaf, n, digest``. Each level sums the one below, a sixteenth of its rows."""
    levels = [leaves.select(F.lit(digits).alias("level"), F.col("leaf").alias("node"), "n", "digest")]
    for level in range(digits - 1, -1, -1):
        below = levels[-1]
        levels.append(below.groupBy(F.substring("node", 1, level + 1).alias("node")).agg(F.sum("n").alias("n"), xor_digest(F.col("digest")).alias("digest")).select(F.lit(level).alias("level"), "node", "n", "digest"))
    return reduce(lambda a, b: a.unionByName(b), levels)


def store_state(entries: DataFrame, folder: str, digits: int = 2) -> StoredState:
    """Write a state by leaf, with its tree. With d digits there are 16 ** d leaves; a leaf should hold some thousands of entries."""
    rows = _by_leaf(entries, digits)
    rows.repartition("leaf").write.mode("overwrite").partitionBy("leaf").parquet(f"{folder}/entries")
    spark = entries.sparkSession
    _sums(_read(spark, folder)).write.mode("overwrite").parquet(f"{folder}/leaves")
    return open_state(spark, folder, digits)


def _by_leaf(entries: DataFrame, digits: int) -> DataFrame:
    return digested(entries).withColumn("leaf", leaf(digits))


def _read(spark: SparkSession, folder: str) -> DataFrame:
    """Entries as they were stored; the schema is known, also where none were."""
    return spark.read.schema(_by_leaf(spark.createDataFrame([], ENTRIES), 1).schema).parquet(f"{folder}/entries")


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), xor_digest(F.col("own")).alias("digest"))


def open_state(spark: SparkSession, folder: str, digits: int = 2) -> StoredState:
    """A state as it was stored. Names of leaves carry an x, as some, such as 00 or 1e2, would be read as numbers without."""
    return StoredState(_read(spark, folder), tree_of(spark.read.parquet(f"{folder}/leaves"), digits), digits)


def changed_tree(tree: DataFrame, before: DataFrame, after: DataFrame, digits: int) -> DataFrame:
    """The tree after entries ``before`` became ``after``: what was is taken out and what is is put in, without a look at the rest."""
    delta = digested(before).select("own", leaf(digits).alias("leaf"), F.lit(-1).alias("by")).unionByName(digested(after).select("own", leaf(digits).alias("leaf"), F.lit(1).alias("by")))
    sums = delta.groupBy("leaf").agg(F.sum("by").alias("dn"), xor_digest(F.col("own")).alias("dx"))
    leaves = tree.filter(F.col("level") == digits).select(F.col("node").alias("leaf"), "n", "digest").join(sums, "leaf", "full_outer")
    n = F.coalesce("n", F.lit(0)) + F.coalesce("dn", F.lit(0))
    return tree_of(leaves.select("leaf", n.alias("n"), xor_hex(F.col("digest"), F.col("dx")).alias("digest")).filter("n > 0"), digits)


def differing_leaves(a: DataFrame, b: DataFrame, digits: int) -> DataFrame:
    """``leaf`` of two trees, found from the root down: a level is only read below nodes that differ."""
    side = lambda t, level, name: t.filter(F.col("level") == level).select("node", F.struct("n", "digest").alias(name))
    open_ = None
    for level in range(digits + 1):
        both = side(a, level, "a").join(side(b, level, "b"), "node", "full_outer")
        if open_ is not None:
            both = both.withColumn("up", F.substring("node", 1, level)).join(open_.withColumnRenamed("node", "up"), "up", "left_semi")
        open_ = keep(both.filter(~F.col("a").eqNullSafe(F.col("b"))).select("node"), f"differ-{level}")
        if open_.isEmpty():
            break  # nothing differs
    return open_.withColumnRenamed("node", "leaf")


def state_difference(a: StoredState, b: StoredState) -> DataFrame:
    """``uuid, state, path_a, path_b`` of entries that two states do not share: only_a, only_b, or differs. Equal leaves are not read."""
    if a.digits != b.digits:
        raise ValueError("the trees have leaves of different sizes")
    leaves = keep(differing_leaves(a.tree, b.tree, a.digits), "leaves")
    names = [r["leaf"] for r in leaves.limit(NAMED + 1).collect()]

    def rows(s: StoredState, name: str) -> DataFrame:
        own = s.entries.filter(F.col("leaf").isin(names)) if len(names) <= NAMED else s.entries.join(leaves, "leaf", "left_semi")
        return own.select("uuid", F.struct("path", "own").alias(name))

    both = rows(a, "a").join(rows(b, "b"), "uuid", "full_outer").filter(~F.col("a.own").eqNullSafe(F.col("b.own")))
    state = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("differs")
    return both.select("uuid", state.alias("state"), F.col("a.path").alias("path_a"), F.col("b.path").alias("path_b"))
