"""A change feed in pages, and what of it counts as a change from outside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import in_control_dir
from ..schema import FEED


def read_changes(spark: SparkSession, folder: str, token: str | None) -> tuple[DataFrame | None, str]:
    """Changes since a page, and the name of the newest page, which is the next token.

    Pages are NDJSON files of one folder, named in order. There are no changes but a null, which asks for a full scan,
    at the first look, when there is no token yet, and when the page of the token is gone, so that what came after it
    may be, too.
    """
    pages = spark.read.format("binaryFile").option("pathGlobFilter", "*.ndjson").load(folder).select(F.col("_metadata.file_name").alias("page"))
    found = pages.agg(F.max("page").alias("last"), F.coalesce(F.bool_or(F.col("page") == F.lit(token)), F.lit(False)).alias("known")).first()
    newest = found["last"] or ""
    if token is None or (token and not found["known"]):
        return None, newest
    rows = spark.read.schema(FEED).option("pathGlobFilter", "*.ndjson").json(folder).select("*", F.col("_metadata.file_name").alias("_page"))
    new = rows.filter((F.col("_page") > token) & (F.col("_page") <= newest)).drop("_page")
    return new.withColumn("removed", F.coalesce("removed", F.lit(False))), newest


def stream_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The same pages as a stream; the checkpoint keeps which pages have been read."""
    rows = spark.readStream.schema(FEED).option("pathGlobFilter", "*.ndjson").json(folder)
    return rows.withColumn("removed", F.coalesce("removed", F.lit(False)))


def external_changes(feed: DataFrame, entries: DataFrame) -> DataFrame:
    """``path`` of changes that are not this side's own: attributed by native id, else by path; echoes and the control folder left out."""
    live = entries.filter("not deleted")
    by_native = live.filter("native is not null").select("native", F.struct("path", "size", "mtime").alias("n"))
    by_path = live.select("path", F.struct("path", "size", "mtime").alias("p"))
    x = feed.join(by_native, "native", "left").join(by_path, "path", "left").withColumn("e", F.coalesce("n", "p"))
    path = F.coalesce("path", "e.path")
    echo = F.col("e").isNotNull() & F.col("size").eqNullSafe(F.col("e.size")) & F.col("mtime").eqNullSafe(F.col("e.mtime")) & ~F.col("removed")
    kept = x.select(path.alias("path"), "removed", echo.alias("echo"), F.col("e").isNotNull().alias("known")).filter(F.col("path").isNotNull())
    kept = kept.filter(~in_control_dir(F.col("path")) & ~F.coalesce("echo", F.lit(False)) & (~F.col("removed") | F.col("known")))
    return kept.select("path").distinct()
