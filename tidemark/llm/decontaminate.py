"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Sets are the distinct runs of five lower-cased words. An item is contained in a document when at least
``least`` of its set is in the document's. Items are partitioned by the size of their sets, in powers of
two; each partition has its own sketch size: the k smallest hashes of an item's set (its bottom-k MinHash
sketch), k being one more than the runs that an item of this partition may miss. So a document that
contains an item holds at least one hash of its sketch, and no item is lost however long the document is.
Documents with fewer runs than the smallest item of a partition needs are not probed against it.
Candidates are verified on the runs themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_rows, row_key, shingle_keys, shingle_texts, words_of


def item_sketches(items: DataFrame, id_col: str, text: str, k: int, least: float) -> DataFrame:
    """``item, size_class, need, h``: the sketch of each item's set; need is the fewest runs a holder has."""
    sets = items.select(F.col(id_col).alias("item"), F.array_distinct(shingle_keys(words_of(F.lower(F.col(text))), k)).alias("s"))
    sets = sets.filter(F.size("s") > 0)
    n = F.size("s")
    sized = sets.withColumn("size_class", F.floor(F.log2(n)).cast("int"))
    largest = (F.pow(F.lit(2.0), F.col("size_class") + 1) - 1).cast("int")
    width = largest - F.ceil(largest * least).cast("int") + 1
    need = F.ceil(F.pow(F.lit(2.0), F.col("size_class")) * least)
    return sized.select("item", "size_class", need.cast("int").alias("need"), F.explode(F.slice(F.array_sort("s"), 1, width)).alias("h"))


#: Bytes of item texts up to which items are broadcast.
BROADCAST_BYTES = 64_000_000


def bounded(sketch: DataFrame, items: DataFrame, text: str, rows: int) -> bool:
    """Whether sketches have at most so many rows, and the items' texts few bytes."""
    if sketch.limit(rows + 1).count() > rows:
        return False
    return items.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0] <= BROADCAST_BYTES


def contained_rows(docs: DataFrame, items: DataFrame, id_col: str, item_col: str, text: str, k: int, least: float, broadcast_rows: int) -> DataFrame:
    """``_id, _h, _n, item, n_item, n_common`` of rows and the items that they contain; the first three are the row's keys."""
    sketch = item_sketches(items, item_col, text, k, least)
    small = bounded(sketch, items, text, broadcast_rows)
    near = F.broadcast if small else lambda x: x
    words = words_of(F.lower(F.col(text)))
    keyed = docs.select(F.col(id_col).alias("_id"), *row_key(text), F.col(text).alias("_text"))
    hashed = docs.select(F.col(id_col).alias("_id"), *row_key(text), shingle_keys(words, k).alias("s"))
    probes = hashed.select("_id", "_h", "_n", F.size("s").alias("runs"), F.explode_outer("s").alias("h"))  # outer: no filter that would make the runs twice
    hits = probes.join(near(sketch), "h").filter(F.col("runs") >= F.col("need"))
    pairs = hits.select("_id", "_h", "_n", "item").distinct()

    sets = items.select(F.col(item_col).alias("item"), shingle_texts(words, k).alias("item_runs"))
    p = pairs.withColumnsRenamed({"_id": "_pid", "_h": "_ph", "_n": "_pn"})
    held = keyed.join(p, keyed["_id"].eqNullSafe(p["_pid"]) & (keyed["_h"] == p["_ph"]) & (keyed["_n"] == p["_pn"]))
    runs = held.select("_id", "_h", "_n", "item", shingle_texts(words_of(F.lower(F.col("_text"))), k).alias("runs"))
    checked = runs.join(near(sets), "item").select(
        "_id", "_h", "_n", "item", F.size("item_runs").cast("long").alias("n_item"), F.size(F.array_intersect("runs", "item_runs")).cast("long").alias("n_common"))
    return checked.filter(F.col("n_common") * 1000 >= F.col("n_item") * round(least * 1000))


def find_contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text", k: int = 5, least: float = 0.75, broadcast_rows: int = 500_000) -> DataFrame:
    """Pairs of a document and an item that it contains: ``id_col, item_col, n_item, n_common, containment``.

    Null and empty texts hold nothing and are held by nothing. A text of fewer than k words is one run.
    Documents that repeat give one row for each id and text. Other columns are ignored; empty tables give no rows.
    A long document is worked on whole. Sketches of up to ``broadcast_rows`` hashes, of texts of up to
    ``BROADCAST_BYTES``, are broadcast, more are joined by a shuffle.
    """
    found = contained_rows(docs, items, id_col, item_col, text, k, least, broadcast_rows)
    return found.select(F.col("_id").alias(id_col), F.col("item").alias(item_col), "n_item", "n_common", (F.col("n_common") / F.col("n_item")).alias("containment"))


def drop_contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text", k: int = 5, least: float = 0.75, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of docs that contain no item, with all their columns; a row without id or words stays, repeated rows stay or go together."""
    rows = contained_rows(docs, items, id_col, item_col, text, k, least, broadcast_rows).select("_id", "_h", "_n").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), *row_key(text))
    return join_rows(keyed, rows, "left_anti", "_id").select(*(F.col(f"_row.`{c}`") for c in docs.columns))
