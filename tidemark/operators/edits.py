"""Changes of a folder as functions of its files (path, kind, size, content): all of a change happens at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import in_control_dir, is_inside
from ..schema import CONTROL_DIR


def _checked(*paths: str) -> None:
    for path in paths:
        if path in ("", CONTROL_DIR) or path.startswith(CONTROL_DIR + "/") or ".." in path.split("/"):
            raise ValueError(f"not a path to change: {path!r}")


def _at_or_below(path: str) -> Column:
    return is_inside(F.col("path"), F.lit(path))


def write_file(files: DataFrame, path: str, content: bytes) -> DataFrame:
    """A file with this content, in place of what was there; a folder cannot be written."""
    _checked(path)
    new = files.sparkSession.createDataFrame([(path, "file", len(content), bytearray(content))], "path string, kind string, size bigint, content binary")
    return files.filter((F.col("path") != path) | (F.col("kind") == "directory")).unionByName(new, allowMissingColumns=True)


def make_dir(files: DataFrame, path: str) -> DataFrame:
    """The folder and those above it, where they are not there yet."""
    _checked(path)
    parts = path.split("/")
    new = files.sparkSession.createDataFrame([("/".join(parts[: i + 1]), "directory", 0) for i in range(len(parts))], "path string, kind string, size bigint")
    return files.unionByName(new.join(files.select("path"), "path", "left_anti"), allowMissingColumns=True)


def delete_path(files: DataFrame, path: str) -> DataFrame:
    """Without the path and all below it; a path that is not there changes nothing."""
    _checked(path)
    return files.filter(~_at_or_below(path))


def rename_path(files: DataFrame, path: str, to: str) -> DataFrame:
    """The path and all below it under another one; what was there goes. The control folder stays where it is."""
    _checked(path, to)
    moved = F.when(_at_or_below(path), F.concat(F.lit(to), F.expr(f"substring(path, {len(path) + 1})"))).otherwise(F.col("path"))
    kept = files.filter(_at_or_below(path) | ~_at_or_below(to) | in_control_dir(F.col("path")))
    return kept.withColumn("path", moved)
