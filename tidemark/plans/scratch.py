"""Tables in the folder that the session names for checkpoints: what cuts lineage must outlive a lost executor."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where both are one process may it be left unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return _local[0]


class Scratch:
    """Tables of one run in a folder of its own; each is removed once nothing reads it any more."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.root, self.names = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", []
        #: Others that go with this one.
        self.parts: list[Scratch] = []

    def save(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path, compression=compression)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
            self.names.remove(name)

    def clear(self) -> None:
        """Remove all tables, and the folder."""
        for part in self.parts:
            part.clear()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def last(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Save what a run returns and remove all other tables of the run."""
        out = self.save(df, name)
        self.drop(*(n for n in list(self.names) if n != name))
        return out


#: The runs that are under way in a thread, the innermost last; tables of ``keep`` belong to it.
_under_way = threading.local()


def _runs() -> list[Scratch]:
    if not hasattr(_under_way, "runs"):
        _under_way.runs = []
    return _under_way.runs


@contextmanager
def run(spark: SparkSession, tag: str, leave: bool = False) -> Iterator[Scratch]:
    """Tables that ``keep`` writes within are this run's, and go at its end, unless ``leave`` hands them to the caller."""
    scratch = Scratch(spark, tag)
    _runs().append(scratch)
    try:
        yield scratch
    finally:
        _runs().remove(scratch)
        if not leave:
            scratch.clear()


def within(spark: SparkSession, tag: str) -> Scratch:
    """Tables of a step that tidies up after itself; what it leaves goes with the run that it belongs to."""
    scratch = Scratch(spark, tag)
    if _runs():
        _runs()[-1].parts.append(scratch)
    return scratch


def keep(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a DataFrame and read it back; the table stays as long as the run that it belongs to."""
    if _runs():
        return _runs()[-1].save(df, f"{name}-{uuid.uuid4().hex}")
    return Scratch(df.sparkSession, name).save(df, "t")
