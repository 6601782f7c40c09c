"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch, shared_dir  # noqa: F401

#: Words as the contracts define them: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    while name in taken:
        name += "_"
    return name


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """The words of a text; no words for a null."""
    return F.coalesce(F.filter(F.split(text, GAP), lambda w: w != ""), F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once, also where body uses it within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_keys(words: Column, k: int = 5) -> Column:
    """64-bit keys of all runs of k words; a shorter text is one run, a text without words none."""

    def keys(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(w[i + j] for j in range(k))))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= k, runs).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(none)

    return let(words, keys)


def shingle_texts(words: Column, k: int = 5) -> Column:
    """The distinct runs of k words as texts, under the same rules."""

    def texts(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.concat_ws(" ", *(w[i + j] for j in range(k))))
        none = F.array().cast("array<string>")
        return F.array_distinct(F.when(F.size(w) >= k, runs).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(none))

    return let(words, texts)


def row_key(text: str = "text") -> list[Column]:
    """What tells the rows of a table apart whose ids may be null or repeat."""
    return [F.xxhash64(F.col(text)).alias("_h"), F.coalesce(F.length(text), F.lit(-1)).alias("_n")]


def join_rows(left: DataFrame, right: DataFrame, how: str, id_col: str = "doc_id") -> DataFrame:
    """Join on id and row_key, where null ids meet null ids; right's keys go."""
    r = right.withColumnsRenamed({id_col: "_rid", "_h": "_rh", "_n": "_rn"})
    out = left.join(r, left[id_col].eqNullSafe(r["_rid"]) & (left["_h"] == r["_rh"]) & (left["_n"] == r["_rn"]), how)
    return out if how in ("left_semi", "left_anti") else out.drop("_rid", "_rh", "_rn")
