"""Structured Streaming forms: a watched folder, a feedback log, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import OUTCOMES


def watch(spark: SparkSession, folder: str, on_files: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None, glob: str | None = None):
    """New and rewritten files under folder, micro-batch by micro-batch, to on_files(rows, batch). interval None: what is there now, then it ends. Deletions are seen by comparing catalogues, see operators.store.prune."""
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    writer = files.writeStream.foreachBatch(on_files).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def reflect_stream(log: DataFrame, half_life: float = 30.0, origin: float = 0.0) -> DataFrame:
    """Feedback by node as a running aggregate: the sum of sign * 2 ^ ((ts - origin) / half life). Decay to a later `now` is one factor for all, so the state only adds; see decayed."""
    weight = F.pow(F.lit(2.0), (F.col("ts") - F.lit(origin)) / F.lit(86400.0 * half_life))
    each = log.where(F.col("outcome").isin(*OUTCOMES)).select(F.explode("source_nodes").alias("node"), (F.col("outcome") == "useful").alias("good"), weight.alias("w"), "ts")
    return each.groupBy("node").agg(F.sum(F.when(F.col("good"), F.col("w")).otherwise(-F.col("w"))).alias("raw"), F.sum(F.col("good").cast("long")).alias("pos"), F.sum((~F.col("good")).cast("long")).alias("neg"), F.max("ts").alias("last"))


def decayed(raw: Column, now: float, half_life: float = 30.0, origin: float = 0.0) -> Column:
    return raw * F.pow(F.lit(2.0), F.lit(-(now - origin) / (86400.0 * half_life)))


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, value): tumbling or sliding windows of events (ts, event_type, value); rows later than `late` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "user_id", "n")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that a finite source gives, as a table: the last state of each batch's output, written by foreachBatch."""
    import uuid

    from ..operators.staging import shared_folder

    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/drain-{uuid.uuid4().hex}"
    last: list[str] = []

    def put(rows: DataFrame, batch: int) -> None:
        at = f"{base}/{'all' if mode == 'append' else batch}"
        rows.write.mode("append" if mode == "append" else "overwrite").parquet(at)
        last[:] = [at]

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(*last) if last else spark.createDataFrame([], stream.schema)
