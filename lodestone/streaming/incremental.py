"""Incremental indexing as a stream of file versions, and windows over event streams."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.index import upsert_files


def latest_versions(batch: DataFrame) -> DataFrame:
    """The newest version of each path in a batch (path, hash, mtime)."""
    return batch.groupBy("path").agg(F.max_by(F.struct("hash", "mtime"), F.struct("mtime", "hash")).alias("v")).select("path", "v.hash", "v.mtime")


def apply_batch(state: DataFrame, batch: DataFrame) -> DataFrame:
    """state with a batch of versions: one that is not newer than the stored file changes nothing."""
    new = latest_versions(batch)
    stored = state.select("path", F.col("mtime").alias("_m"))
    fresh = new.join(stored, "path", "left").where("_m is null or mtime > _m").drop("_m")
    return upsert_files(state, fresh)


def index_stream(versions: DataFrame, root: str, checkpoint: str):
    """A query that keeps the latest state below root, one folder a batch; a batch that is run again writes the same folder."""
    spark: SparkSession = versions.sparkSession
    empty = spark.createDataFrame([], "path string, hash string, mtime long, summary string")

    def step(batch: DataFrame, number: int):
        before = spark.read.parquet(f"{root}/{number - 1}") if number else empty
        apply_batch(before, batch).write.mode("overwrite").parquet(f"{root}/{number}")

    return versions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by tumbling, or with slide by sliding windows of ts, waiting `late` for late rows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n): a user's events without a pause of `gap`."""
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")
