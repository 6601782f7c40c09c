"""Logs that tell each other apart by small sketches: invertible Bloom lookup tables of operation ids.

A table has a fixed number of cells. Every op is added to three of them: a count, the XOR of its id and the XOR of a check
of its id, all of which combine map-side. Subtracting one log's table from the other's leaves the operations that only one
of them has; a cell with a single one gives it away, and taking it out of its other cells opens further ones. Up to about
two thirds as many operations as there are cells come out so, whatever the size of the logs. What does not open
completely is settled by the exact anti-join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import xor_digest
from .logset import missing_rows

CELLS, WAYS = 600, 3


def _check(op: Column) -> Column:
    return F.xxhash64(F.lit("check"), op)


def _place(op: Column, way: int, cells: int) -> Column:
    """Each way has a third of the cells of its own, so the cells of an op are never the same."""
    each = cells // WAYS
    return F.pmod(F.xxhash64(F.lit(way), op), F.lit(each)) + way * each


def sketch(log: DataFrame, cells: int = CELLS) -> DataFrame:
    """``cell, n, op, sum`` of a log whose rows have distinct ids of 64 hex digits; as many rows as there are cells at most."""
    if cells % WAYS or cells < WAYS:
        raise ValueError(f"cells must be a multiple of {WAYS}")
    ways = F.array(*(_place(F.col("op"), w, cells) for w in range(WAYS)))
    rows = log.select("op", _check(F.col("op")).alias("sum"), F.explode(ways).alias("cell"))
    return rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), xor_digest(F.col("op")).alias("op"), F.bit_xor("sum").alias("sum"))


def _cells(table: DataFrame, cells: int) -> tuple[np.ndarray, list[int], list[int]]:
    n, op, check = np.zeros(cells, np.int64), [0] * cells, [0] * cells
    for r in table.collect():  # as many rows as there are cells
        n[r["cell"]], op[r["cell"]], check[r["cell"]] = r["n"], int(r["op"], 16), r["sum"] & (1 << 64) - 1
    return n, op, check


def open_difference(a: DataFrame, b: DataFrame, cells: int = CELLS) -> tuple[list[str], list[str]] | None:
    """The ids that only a's log has, and those that only b's has, from two sketches; null where there are too many to open.

    An id that a cell gives away is believed only if its check is right and it belongs to that cell.
    """
    spark = a.sparkSession
    (na, oa, ca), (nb, ob, cb) = _cells(a, cells), _cells(b, cells)
    n, op, check = na - nb, [x ^ y for x, y in zip(oa, ob, strict=True)], [x ^ y for x, y in zip(ca, cb, strict=True)]
    found: dict[str, int] = {}
    while True:
        ready = {f"{op[i]:064x}": i for i in range(cells) if abs(n[i]) == 1}
        if not ready:
            break
        # the places of all that may come out are worked out as they were put in
        ids = spark.createDataFrame([(x,) for x in ready], "op string")
        known = ids.select("op", _check(F.col("op")).alias("sum"), F.array(*(_place(F.col("op"), w, cells) for w in range(WAYS))).alias("cells")).collect()
        taken = 0
        for r in known:
            i = ready[r["op"]]
            value, own = int(r["op"], 16), r["sum"] & (1 << 64) - 1
            if op[i] != value or check[i] != own or abs(n[i]) != 1 or i not in r["cells"] or r["op"] in found:
                continue
            side, taken = int(n[i]), taken + 1
            found[r["op"]] = side
            for c in r["cells"]:
                n[c] -= side
                op[c] ^= value
                check[c] ^= own
        if not taken:
            break
    if n.any() or any(op) or any(check):
        return None
    return sorted(x for x, s in found.items() if s > 0), sorted(x for x, s in found.items() if s < 0)


def exchanged_rows(a: DataFrame, b: DataFrame, cells: int = CELLS) -> tuple[DataFrame, DataFrame, bool]:
    """The rows that a lacks, those that b lacks, and whether the sketches told: as missing_rows gives them.

    Where they did, each log is filtered by the few ids found; where not, the logs are joined.
    """
    distinct = lambda log: log.dropDuplicates(["op"])
    opened = open_difference(sketch(a, cells), sketch(b, cells), cells)
    if opened is None:
        return missing_rows(a, b), missing_rows(b, a), False
    only_a, only_b = opened
    named = lambda log, ids: distinct(log.filter(F.col("op").isin(ids) if ids else F.lit(False)))
    return named(b, only_b), named(a, only_a), True
