"""Tables that several writers append to at once: numbered manifests, each made only if no one else has made it.

A manifest names all folders of data that belong to a version of the table. A writer puts its data in a folder of its own,
which no one sees, and then makes the next manifest; the store lets one writer make a name. Who loses the race
looks at what the winner brought, leaves out what is there by now, and tries the next number. Readers stay with the manifest
that they began with.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .storage import resolve

DIGITS = 12


def create_absent(spark: SparkSession, uri: str, data: bytes) -> bool:
    """Make a file with its content in one step, unless it is there; whether this call made it.

    On a local file system the finished file is linked to its name; elsewhere the Hadoop file system decides, for which the
    store must refuse to create what is there at once, as HDFS does.
    """
    system, path = resolve(uri) if uri.startswith(("file:", "/")) else (None, uri)
    if system is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temp = f"{path}.{uuid.uuid4().hex}"
        with open(temp, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(temp, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(temp)
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(uri)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        out = store.create(place, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(data))
    out.close()
    return True


@dataclass
class Table:
    """An append-only table in a folder, with a schema that stays."""

    spark: SparkSession
    folder: str
    schema: T.StructType

    def _name(self, number: int) -> str:
        return f"{self.folder}/manifests/{number:0{DIGITS}d}.json"

    def latest(self) -> int:
        """The newest manifest's number; 0 where there is none. Names are numbers, and a listing of them is all that is read."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests")
        store = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        names = [s.getPath().getName() for s in store.listStatus(root)] if store.exists(root) else []
        return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit()], default=0)

    def parts(self, number: int) -> list[str]:
        """Folders of data of a version."""
        if number == 0:
            return []
        return json.loads(self.spark.read.text(self._name(number), wholetext=True).first()["value"])["parts"]

    def read(self, number: int | None = None, after: int = 0) -> DataFrame:
        """The rows of a version, the newest by default; with ``after`` only what versions after that one have brought."""
        old = set(self.parts(after))
        parts = [p for p in self.parts(self.latest() if number is None else number) if p not in old]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/data/{p}" for p in parts))

    def append(self, rows: DataFrame, key: str | None = None, most: int = 100, before_commit: Callable[[int], None] | None = None) -> int:
        """Append rows, and return the number of the version that has them.

        With ``key`` only rows whose key is not there yet are appended, each key once: a race that is lost is followed
        by another look at what has come since. Where nothing is new, no version is made. Folders of lost races that no
        manifest names are not part of the table. ``before_commit`` is called with each number that is tried.
        """
        base, fresh, name = self.latest(), rows.select(*self.schema.fieldNames()), ""
        if key is not None:
            fresh = fresh.dropDuplicates([key]).join(self.read(base).select(key), key, "left_anti").select(*self.schema.fieldNames())
        for _ in range(most):
            if not name:
                name = uuid.uuid4().hex
                fresh.write.parquet(f"{self.folder}/data/{name}")
                fresh = self.spark.read.schema(self.schema).parquet(f"{self.folder}/data/{name}")
                if fresh.isEmpty():
                    return base
            if before_commit is not None:
                before_commit(base + 1)
            manifest = json.dumps({"parts": [*self.parts(base), name]}).encode()
            if create_absent(self.spark, self._name(base + 1), manifest):
                return base + 1
            now = self.latest()
            if key is not None:
                came = self.read(now, after=base).select(key)
                if not fresh.join(came, key, "left_semi").isEmpty():
                    fresh, name = fresh.join(came, key, "left_anti").select(*self.schema.fieldNames()), ""
            base = now
        raise RuntimeError(f"{most} races were lost in a row")

    def compact(self, before_commit: Callable[[int], None] | None = None) -> int | None:
        """A version with all rows in one folder; null where another writer came first, and nothing is changed then."""
        base = self.latest()
        name = uuid.uuid4().hex
        self.read(base).write.parquet(f"{self.folder}/data/{name}")
        if before_commit is not None:
            before_commit(base + 1)
        return base + 1 if create_absent(self.spark, self._name(base + 1), json.dumps({"parts": [name]}).encode()) else None


def open_table(spark: SparkSession, folder: str, schema: str | T.StructType) -> Table:
    kind = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
    return Table(spark, folder.rstrip("/"), kind)
