"""The verdict log and telemetry as streams: the batch operators' semantics over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.logs import DETECTION_FIELDS, parse_detections


def live_log(events: DataFrame, delay: str = "1 hour", id_col: str = "id", at: str = "at") -> DataFrame:
    """Verdict events once each: a call id seen again within ``delay`` of event time is dropped, later rows are late."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([id_col])


def append_log(log: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """The live log as a day-partitioned table."""
    w = (log.withColumn("date", F.to_date("at")).writeStream.format("parquet").outputMode("append").partitionBy("date")
         .option("path", path).option("checkpointLocation", checkpoint))
    return (w.trigger(availableNow=True) if once else w).start()


def rolling_latency(log: DataFrame, width: str = "30 minutes", delay: str = "1 hour", accuracy: int = 10_000) -> DataFrame:
    """Volume and median latency per tumbling window; a window is final once ``delay`` has passed it."""
    ok = F.col("ok")
    return (log.withWatermark("at", delay).groupBy(F.window("at", width)).agg(
        F.count_if(ok).alias("n"), F.avg(F.when(ok, F.col("latency_ms"))).alias("mean_ms"),
        F.percentile_approx(F.when(ok, F.col("latency_ms")), 0.5, accuracy).alias("p50_ms"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean_ms", "p50_ms"))


def rolling_uptime(log: DataFrame, width: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Share of successful requests per sliding window."""
    n = F.count(F.lit(1))
    return (log.withWatermark("at", delay).groupBy(F.window("at", width, slide)).agg(
        n.alias("n"), F.count_if("ok").alias("ok"), F.bround(F.count_if("ok") * 100.0 / n, 2).alias("uptime"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "ok", "uptime"))


def quarantine_writer(good: str, quarantine: str, body: str = "body"):
    """``foreachBatch`` body with two sinks. A batch owns its folder, so a batch run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        p = parse_detections(batch, body).withColumn("timestamp", F.current_timestamp())
        p.persist()
        try:
            p.where("problem is null").select("timestamp", *DETECTION_FIELDS).write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
            p.where("problem is not null").select("timestamp", body, "problem").write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        finally:
            p.unpersist()

    return write


def detection_stream(events: DataFrame, good: str, quarantine: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    w = events.writeStream.foreachBatch(quarantine_writer(good, quarantine)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
