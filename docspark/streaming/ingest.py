"""Streaming ingest: new documents to corpus tables, one idempotent folder a batch.

Every micro-batch writes its tables to folders of its own, which become valid all at once when
the manifest is switched; a batch that is run again before that replaces its own output and
nothing else. A document delivered again gets rows in a later batch; readers take the latest
batch of each document, by the catalog. `compact` folds the current rows of many batches into
one, so that neither the history nor the number of folders grows with time.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import file_extension
from ..plans.ingest import IngestOptions, ingest
from ..sources.files import decode_text
from ..sources.snapshots import Snapshots
from ..functions import constants as K

TABLES = ("catalog", "doc_text", "pages", "chunks", "vectors", "postings")
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def text_file_stream(spark: SparkSession, path: str, per_trigger: int = 10_000) -> DataFrame:
    """Arriving files as (doc_id, filename, file_size_bytes, upload_date, text, reason). A file that
    is no text file or too large comes without text and with the reason, and ends as a failed
    catalog row."""
    files = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE)
        .option("maxFilesPerTrigger", per_trigger).load(path)
    )
    ext = file_extension("path")
    reason = (F.when(~(ext.isin(K.TEXT_EXTENSIONS) & ext.isin(K.ALLOWED_EXTENSIONS)), "unsupported format")
              .when(F.col("length") > K.MAX_UPLOAD_BYTES, "too large"))
    return files.select(
        F.md5(F.concat_ws("|", "path", F.col("length").cast("string"))).alias("doc_id"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("file_size_bytes"),
        F.col("modificationTime").alias("upload_date"),
        F.when(reason.isNull(), decode_text(F.col("content"))).alias("text"),
        reason.alias("reason"),
    )


def latest_delivery(files: DataFrame) -> DataFrame:
    """X5 inside a batch: the newest delivery of a document wins."""
    rest = [c for c in files.columns if c != "doc_id"]
    newest = F.max_by(F.struct(*rest), F.struct("upload_date", "file_size_bytes", "text"))
    return files.groupBy("doc_id").agg(newest.alias("f")).select("doc_id", "f.*").select(*files.columns)


def drop_redelivered(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """X5 across batches: an unchanged document delivered again within the delay is not ingested again.

    The delay counts from arrival, so a document whose own date is old is never lost.
    """
    marked = stream.withColumns({"_digest": F.md5(F.coalesce("text", F.lit(""))), "_arrived": F.current_timestamp()})
    return marked.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(["doc_id", "_digest"]).drop("_digest", "_arrived")


def ingest_batch(files: DataFrame, batch_id: int, out: str, dims: DataFrame, cats: DataFrame,
                 options: IngestOptions | None = None) -> None:
    """Adds one batch to the tables under `out`; a batch that is valid already is left alone."""
    shots = Snapshots(files.sparkSession, out)
    if batch_id in shots.read().get("batches", []):
        return
    files = latest_delivery(files).persist()
    try:
        tables = ingest(files, dims, cats, options)
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{shots.root}/{_folder(name, batch_id)}")
    finally:
        files.unpersist()
    now = shots.read()
    shots.commit({"tables": {n: [*now["tables"].get(n, []), _folder(n, batch_id)] for n in TABLES},
                  "batches": [*now.get("batches", []), batch_id]})
    shots.vacuum()


def _folder(name: str, batch_id: int, kind: str = "b") -> str:
    return f"{name}/part={kind}{batch_id}/batch={batch_id}"


def compact(spark: SparkSession, out: str) -> None:
    """Writes the current rows of all batches as one and switches to it; the folders before go with the next
    versions. A reader that began before keeps its version. Not while a batch is being added."""
    shots = Snapshots(spark, out)
    now = shots.read()
    if len(now.get("batches", [])) < 2:
        return
    last = max(now["batches"])
    for name, df in read_tables(spark, out).items():
        df.write.mode("overwrite").parquet(f"{shots.root}/{_folder(name, last, 'c')}")
    shots.commit({"tables": {n: [_folder(n, last, "c")] for n in TABLES}, "batches": now["batches"]})
    shots.vacuum()


def ingest_stream(stream: DataFrame, out: str, checkpoint: str, dims: DataFrame, cats: DataFrame,
                  options: IngestOptions | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts the query. `trigger` defaults to what has arrived, then stops."""
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(lambda df, n: ingest_batch(df, n, out, dims, cats, options))
        .start()
    )


def read_tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """Current rows of every table, as of one version: those of each document's latest batch."""
    shots = Snapshots(spark, out)
    now = shots.read()
    raw = {n: shots.table(n, now).drop("part") for n in TABLES}
    latest = raw["catalog"].groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return {n: df.join(latest, ["doc_id", "batch"], "left_semi").drop("batch") for n, df in raw.items()}
