"""Ingest progress as an event stream: latest record and silence limit."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import constants as K
from ..session import remove_folder

DONE = ("completed", "failed")


def step_percent(step, current=None, total=None):
    """Progress percentage of a step; parsing moves from 5 to 65 with its pages."""
    parsing = 5 + F.floor(current / F.greatest(total, F.lit(1)) * 60) if current is not None else F.lit(5)
    return (
        F.when(step == "parsing", parsing.cast("int")).when(step == "ai_tagging", 65).when(step == "chunking", 70)
        .when(step == "embedding", 76).when(step == "saving", 93).otherwise(0)
    )


def latest_progress(progress: DataFrame, keep_done: bool = True) -> DataFrame:
    """Last record of each document; works on a table and, in update or complete mode,
    on a stream. The aggregate combines before the shuffle."""
    last = progress.groupBy("doc_id").agg(F.max(F.struct("ts", "step", "pct", "detail")).alias("r")).select("doc_id", "r.*")
    return last if keep_done else last.filter(~F.col("step").isin(*DONE))


def silent_documents(progress: DataFrame, now, hours: int = 2) -> DataFrame:
    """X3 on a table: unfinished documents without a record for longer than the limit."""
    last = latest_progress(progress, keep_done=False)
    return last.filter(F.col("ts") < now - F.expr(f"interval {hours} hours")).select(
        "doc_id", "ts", F.lit("failed").alias("status"), F.lit(K.STALE_MESSAGE).alias("error_message"))


def track_progress(stream: DataFrame, silence_hours: int = 2, delay: str = "2 hours") -> DataFrame:
    """X2 and X3 on a stream: (doc_id, ts, step, pct, status, error_message) on every change.

    State is one record a document and is dropped once nothing has come for the limit, so
    it does not grow with the number of documents ever seen. An ended document is remembered
    that long too: a record that comes late does not start it again.
    """
    limit_ms = silence_hours * 3600 * 1000
    done, message = DONE, K.STALE_MESSAGE
    id_type = stream.schema["doc_id"].dataType.simpleString()

    def update(key, frames, state):
        if state.hasTimedOut:
            ts, step, pct = state.get
            state.remove()
            if step not in done:
                yield pd.DataFrame({"doc_id": [key[0]], "ts": [pd.Timestamp(ts, unit="us")], "step": [step], "pct": [pct],
                                    "status": ["failed"], "error_message": [message]})
            return
        ts, step, pct = state.get if state.exists else (-1, "", 0)
        for f in frames:
            f = f.assign(us=f["ts"].astype("datetime64[us]").astype("int64"))
            r = f.sort_values(["us", "step", "pct"]).iloc[-1]
            if (r["us"], r["step"], r["pct"]) > (ts, step, pct):
                ts, step, pct = int(r["us"]), str(r["step"]), int(r["pct"])
        state.update((ts, step, pct))
        state.setTimeoutTimestamp(max(ts // 1000 + limit_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"doc_id": [key[0]], "ts": [pd.Timestamp(ts, unit="us")], "step": [step], "pct": [pct],
                            "status": [step if step in done else "processing"], "error_message": [None]})

    return (
        stream.select("doc_id", F.col("ts").cast("timestamp").alias("ts"), "step", "pct").withWatermark("ts", delay).groupBy("doc_id")
        .applyInPandasWithState(
            update,
            f"doc_id {id_type}, ts timestamp, step string, pct int, status string, error_message string",
            "ts bigint, step string, pct int", "update", GroupStateTimeout.EventTimeTimeout)
    )


def write_latest(stream: DataFrame, out: str, checkpoint: str, mode: str = "complete",
                 trigger: dict | None = None) -> StreamingQuery:
    """Writes each batch to `out`/batch=<id>, every five seconds unless told otherwise. A
    complete-mode stream's current answer is its newest batch: see read_latest; all but the last
    three of these are removed."""
    def save(df, n):
        df.write.mode("overwrite").parquet(f"{out}/batch={n}")
        if mode == "complete" and n >= 3:
            remove_folder(df.sparkSession, f"{out}/batch={n - 3}")

    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"})).foreachBatch(save).start()
    )


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest finished batch of a complete-mode stream; other batches are not read."""
    batches = spark.read.parquet(out)
    newest = batches.agg(F.max("batch")).scalar()
    return batches.where(F.col("batch") == newest).drop("batch")
