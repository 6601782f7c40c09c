"""Operation logs stored by store and segment, so that reads of some segments open no others.

Each segment is a partition of files; what is known of all of them (rows, span of time, digest) is a table of its own
with a row a segment. Reads by time join that table, from which Spark learns at run time which partitions of the log
to open, as long as it takes the table for small enough to broadcast; reads by mark name their partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import xor_digest
from ..schema import LOG

#: Columns of the partitions come last, as Spark reads them.
KEYS = ("store", "segment")
FACTS = "store string, segment bigint, rows bigint, min_at bigint, max_at bigint, last_seq bigint, digest string"


@dataclass
class SegmentedLog:
    spark: SparkSession
    folder: str
    schema: str = LOG + ", seq bigint"

    def __post_init__(self) -> None:
        self._kind = self.spark.createDataFrame([], self.schema).schema

    def rows(self) -> DataFrame:
        if not self._there("log"):
            return self.spark.createDataFrame([], self._kind)
        return self.spark.read.schema(self._kind).parquet(f"{self.folder}/log")

    def facts(self) -> DataFrame:
        """A row a segment: FACTS. Appends add rows to it, which come together here."""
        if not self._there("facts"):
            return self.spark.createDataFrame([], FACTS)
        every = self.spark.read.schema(FACTS).parquet(f"{self.folder}/facts")
        return every.groupBy(*KEYS).agg(F.sum("rows").alias("rows"), F.min("min_at").alias("min_at"), F.max("max_at").alias("max_at"), F.max("last_seq").alias("last_seq"), xor_digest(F.col("digest")).alias("digest"))

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def append(self, rows: DataFrame) -> None:
        """Add rows that are not there yet; their segments and seq are given. Each segment's rows go to as few files as they fit in."""
        names = [f.name for f in self._kind]
        full = rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self._kind))
        full.select(*names).repartition(*KEYS).write.mode("append").partitionBy(*KEYS).parquet(f"{self.folder}/log")
        facts = full.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows"), F.min("at_ms").alias("min_at"), F.max("at_ms").alias("max_at"), F.coalesce(F.max("seq"), F.lit(0)).cast("bigint").alias("last_seq"), xor_digest(F.col("op")).alias("digest"))
        facts.write.mode("append").parquet(f"{self.folder}/facts")

    def of(self, wanted: Column) -> DataFrame:
        """The rows of the segments whose facts meet a condition; other partitions are not opened."""
        some = self.facts().filter(wanted).select(*KEYS)
        return self.rows().join(some, list(KEYS), "left_semi")

    def since(self, at_ms: int) -> DataFrame:
        """Rows of the segments that reach to a moment or beyond."""
        return self.of(F.col("max_at") >= at_ms)

    def open_rows(self, store: str, segment: int, mark: tuple[int, int] | None = None) -> DataFrame:
        """A store's open segment from where a mark (segment, seq) ends; all of it where the store has begun another since."""
        own = self.rows().filter((F.col("store") == store) & (F.col("segment") == segment))
        return own.filter(F.col("seq") > mark[1]) if mark is not None and mark[0] == segment else own
