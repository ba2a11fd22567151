"""Request lifecycles as a stream: states kept up to date as events arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.runtime import last_state
from lectern.sources.adapters import STATES

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """seq, request_id, state, t of events as files of them arrive in a folder."""
    e = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)
    state = F.lit("queued")
    for k, v in STATES.items():
        state = F.when(F.col("event_type") == k, v).otherwise(state)
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("request_id"), state.alias("state"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))


def live_states(events: DataFrame) -> DataFrame:
    """The state of each request; the same aggregation as in batch, kept by the state store."""
    return last_state(events)


def minute_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Extension: events of each state a minute, closed once the watermark has passed."""
    e = events.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", late)
    return e.groupBy(F.window("at", "1 minute").alias("w"), "state").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("minute"), "state", "n")


def run_available(spark: SparkSession, frame: DataFrame, mode: str) -> DataFrame:
    """All that has arrived by now, through a table in the folder that the cluster shares.  Each batch
    writes its own folder, so a batch that is run again replaces itself; the last batch is read."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints").rstrip("/")
    folder = f"{base}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    q = frame.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return out.drop("batch")
