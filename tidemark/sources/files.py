"""Folders, operation logs and store documents as DataFrames, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestors, dirname, in_control_dir
from ..schema import CONTROL_DIR

LOG_ROW = "op string, batch string, at bigint, peer string, uuid string, type string, kind string, path string, hash string, size bigint, prev string, prev2 string, prevPath string"
HEADER = "version int, storeId string, peer string, state string, log struct<segment bigint, digest string, rows bigint, size bigint>, peers map<string, struct<lastSync bigint, segment bigint, offset bigint, digest string>>, text array<string>"
ENTRY = "uuid string, kind string, path string, hash string, size bigint, created bigint, updated bigint, peer string, deleted boolean, prev string, prev2 string, prevPath string, native string, mtime bigint, conflictOf string, reason string, base string, held string"


def walk(spark: SparkSession, root: str, ignore: Column | None = None, directories: bool = False, content: bool = False) -> DataFrame:
    """A recursive listing: ``path`` from root, ``kind, size, mtime`` and, if asked for, ``content``.

    Content is read only where a query uses it. The control folder and ignored paths are left out, and with an
    ignored directory all below it; ``ignore`` is a condition on the column ``path``. Directories are those above files.
    """
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    full = F.regexp_replace("path", "^file:/+", "/")
    start = F.regexp_replace(F.lit(base), "^file:/+", "/")
    rel = F.substr(full, F.length(start) + 1)
    columns = [rel.alias("path"), F.lit("file").alias("kind"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime")]
    files = raw.select(*columns, *(["content"] if content else [])).filter(~in_control_dir(F.col("path"), CONTROL_DIR))
    if ignore is not None:
        up = files.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("above")).withColumnRenamed("path", "leaf")
        dropped = up.withColumnRenamed("above", "path").filter(ignore).select(F.col("leaf").alias("path")).distinct()
        files = files.join(dropped, "path", "left_anti")
    if directories:
        dirs = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
        none = [F.lit(None).cast("binary").alias("content")] if content else []
        files = files.unionByName(dirs.select("path", F.lit("directory").alias("kind"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("mtime"), *none))
    return files


def list_dir(files: DataFrame, path: str) -> DataFrame:
    """What stands right in a directory; a missing one has nothing."""
    return files.filter(dirname(F.col("path")) == path)


def stat(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path).select("kind", "size", "mtime")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of NDJSON segments; blank, torn and non-object lines are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    whole = lines.filter(F.startswith("line", F.lit("{")) & F.endswith("line", F.lit("}")) & F.try_parse_json("line").isNotNull())
    return log_columns(whole.select(F.from_json("line", LOG_ROW).alias("r")).select("r.*"))


def log_columns(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"at": "at_ms", "prevPath": "prev_path"})


def encode_rows(log: DataFrame) -> DataFrame:
    """One JSON text a row, keys sorted, absent fields dropped: ``value``."""
    names = {"at_ms": "at", "prev_path": "prevPath"}
    fields = sorted((names.get(c, c), c) for c in log.columns if c not in ("store", "segment"))
    return log.select(F.to_json(F.struct(*(F.col(c).alias(n) for n, c in fields))).alias("value"))


def encode_entries(entries: DataFrame) -> DataFrame:
    """One JSON text an entry, ``path, uuid, value``, in the order of ENTRY; absent fields and a false ``deleted`` are dropped."""
    names = {"prevPath": "prev_path", "conflictOf": "conflict_of"}
    fields = [f.split()[0] for f in ENTRY.split(", ")]
    value = lambda c: F.when(F.col(c), True) if c == "deleted" else F.col(c)
    have = [(n, names.get(n, n)) for n in fields if names.get(n, n) in entries.columns]
    return entries.select("path", "uuid", F.to_json(F.struct(*(value(c).alias(n) for n, c in have))).alias("value"))


def write_entries(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines, sorted by path and uuid across the files."""
    encode_entries(entries).orderBy("path", "uuid").select("value").write.mode("overwrite").text(path)


def observed(df: DataFrame, name: str, size: str = "size") -> tuple[DataFrame, Observation]:
    """The rows with a count of them and of their bytes, which can be asked for once an action has run over them."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")), seen


def write_log(log: DataFrame, path: str) -> None:
    encode_rows(log).write.mode("append").text(path)


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """Store documents without their entries."""
    return spark.read.schema(HEADER).option("multiLine", "true").json(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(f"peer string, entries array<struct<{', '.join(f.replace(' ', ':', 1) for f in ENTRY.split(', '))}>>").option("multiLine", "true").json(path)
    rows = doc.select(F.explode("entries").alias("e")).select("e.*").withColumnsRenamed({"prevPath": "prev_path", "conflictOf": "conflict_of"})
    return rows.withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def decode_text(content: Column) -> Column:
    """UTF-8 text of bytes: invalid ones become U+FFFD, a byte order mark goes."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿", "")
