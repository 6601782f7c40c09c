"""Places of rows in an order, without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import keep


def numbered(ordered: DataFrame, name: str = "place") -> DataFrame:
    """The rows of a sorted DataFrame with their places from 1.

    A row's number within its partition is part of the sort; how many rows the partitions before it hold is a sum over
    as many rows as there are partitions.
    """
    rows = keep(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33).alias("_part")
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select("_part", before.alias("_before"))
    placed = rows.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(shift), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")
