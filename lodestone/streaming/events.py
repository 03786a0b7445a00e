"""Streaming: append-only audit events, ordered run traces and incremental index refresh.

The batch operators of this library have no streaming counterpart in the reference semantics; the windowed counts are an
extension.  All sources are file streams, so that a restart resumes from the checkpoint the caller names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AUDIT = "ts timestamp, event string, payload map<string,string>"


def audit_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Audit events of a folder of JSON lines; damaged lines give null events and are dropped."""
    return spark.readStream.schema(AUDIT).option("mode", "PERMISSIVE").json(folder).where("event is not null")


def append_audit(events: DataFrame, folder: str) -> None:
    """Adds events, stamped in UTC where they carry no time."""
    stamped = events.withColumn("ts", F.coalesce("ts", F.current_timestamp()))
    stamped.select("ts", "event", "payload").write.mode("append").json(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per type and window; rows later than ``late`` are left out of closed windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event", "n")


def refresh_index(stream: DataFrame, target: str, checkpoint: str, key: str = "relpath", digest: str = "content_digest"):
    """Keeps one row per key and digest: every micro-batch appends only what the target does not hold yet."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key, digest])
        try:
            held = spark.read.parquet(target).select(key, digest)
            fresh = fresh.join(held, [key, digest], "left_anti")
        except Exception as error:  # noqa: BLE001 - a target that does not exist yet holds nothing
            if "PATH_NOT_FOUND" not in str(error):
                raise
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
