"""Paths as Column functions: '/'-separated, relative to a root, the root itself being ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    """Drop empty and '.' parts, resolve '..'; a path that leaves the root is an error."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    kept = F.filter(parts, lambda p: (p != "") & (p != "."))
    outside = F.raise_error(F.concat(F.lit("path leaves the root: "), path)).cast("array<string>")
    fold = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & (F.size(acc) == 0), outside).when(p == "..", F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(fold, "/")


def join_path(*parts: Column) -> Column:
    return normalize(F.concat_ws("/", *parts))


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    """A name without its extension; a dot in first place starts none."""
    return F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?\z", 1)


def suffix(name: Column) -> Column:
    """The extension with its dot, in the case given."""
    return F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?\z", 2)


def extension(path: Column) -> Column:
    """The lower-cased extension of the last part, without its dot."""
    return F.lower(F.regexp_extract(path, r"(?:^|/)[^/]+\.([^./]*)\z", 1))


def sort_key(text: Column) -> Column:
    """Orders texts by UTF-16 code units, as peers that exchange digests do; bytes of UTF-8 order characters beyond U+FFFF otherwise."""
    return F.encode(text, "UTF-16BE")


def is_inside(path: Column, directory: Column) -> Column:
    return (directory == "") | (path == directory) | F.startswith(path, F.concat(directory, F.lit("/")))


def ancestors(path: Column) -> Column:
    """Every directory above a path, outermost first, without the root."""
    parts = F.split(path, "/")
    some = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(F.size(parts) > 1, some).otherwise(F.array().cast("array<string>"))


def in_control_dir(path: Column, control: str = ".vfs") -> Column:
    return (path == control) | F.startswith(path, F.lit(control + "/"))


def conflict_name(path: Column, peer: Column, hash_: Column) -> Column:
    """dir/stem (conflict peer hash8)ext."""
    directory, name = dirname(path), basename(path)
    head = F.when(directory == "", F.lit("")).otherwise(F.concat(directory, F.lit("/")))
    return F.concat(head, stem(name), F.lit(" (conflict "), peer, F.lit(" "), F.substring(hash_, 1, 8), F.lit(")"), suffix(name))

