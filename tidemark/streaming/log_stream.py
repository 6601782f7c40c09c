"""Operation logs as streams: rows arrive in any order and more than once, and each counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import LOG_ROW, log_columns


def log_stream(spark: SparkSession, folder: str, late: str | None = None) -> DataFrame:
    """New rows of NDJSON segments. With ``late`` (such as '1 day'), duplicates further apart than that may pass, and state stays bounded."""
    lines = spark.readStream.text(folder).select(F.trim("value").alias("line"))
    whole = lines.filter(F.startswith("line", F.lit("{")) & F.endswith("line", F.lit("}")) & F.try_parse_json("line").isNotNull())
    rows = log_columns(whole.select(F.from_json("line", LOG_ROW).alias("r")).select("r.*"))
    if late is None:
        return rows.dropDuplicates(["op"])
    return rows.withColumn("_at", F.timestamp_millis("at_ms")).withWatermark("_at", late).dropDuplicatesWithinWatermark(["op"]).drop("_at")


FIELDS = ("path", "hash", "deleted", "updated")


def _parts(spark: SparkSession, folder: str) -> dict[str, list[int]]:
    """Numbers of the finished bases and deltas."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out: dict[str, list[int]] = {"base": [], "delta": []}
    for status in fs.listStatus(root) if fs.exists(root) else []:
        kind, _, number = status.getPath().getName().partition("-")
        if kind in out and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            out[kind].append(int(number))
    return {k: sorted(v) for k, v in out.items()}


def read_latest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The latest row of each uuid: the newest base, and the deltas of the batches after it; null where nothing has come yet."""
    parts = _parts(spark, folder)
    bases = [n for n in parts["base"] if before is None or n < before]
    deltas = [n for n in parts["delta"] if (not bases or n > bases[-1]) and (before is None or n < before)]
    paths = [f"{folder}/base-{n}" for n in bases[-1:]] + [f"{folder}/delta-{n}" for n in deltas]
    if not paths:
        return None
    rows = spark.read.parquet(*paths)
    return rows.groupBy("uuid").agg(F.max_by(F.struct(*FIELDS, "op"), F.struct("updated", "op")).alias("r")).select("uuid", "r.*")


def upsert_latest(stream: DataFrame, folder: str, checkpoint: str, compact: int = 20) -> StreamingQuery:
    """Keep the latest row of each uuid: a batch writes what is new of it alone, and every ``compact`` batches one base takes their place.

    Deltas and bases are named by batch number, so a batch that runs again writes the same ones. What a base holds is
    removed one base later, when no reader needs it any more.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = batch.select("uuid", "path", "hash", (F.col("type") == "delete").alias("deleted"), F.col("at_ms").alias("updated"), "op")
        newest = now.groupBy("uuid").agg(F.max_by(F.struct(*FIELDS, "op"), F.struct("updated", "op")).alias("r")).select("uuid", "r.*")
        newest.write.mode("overwrite").parquet(f"{folder}/delta-{number}")
        if number and number % compact == 0:
            whole = read_latest(spark, folder, number + 1)
            whole.write.mode("overwrite").parquet(f"{folder}/base-{number}")
            fs = spark._jvm.org.apache.hadoop.fs
            for kind, numbers in _parts(spark, folder).items():
                for n in numbers:
                    if n <= number - compact:
                        path = fs.Path(f"{folder}/{kind}-{n}")
                        if kind == "delta" or n < number - compact:
                            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
