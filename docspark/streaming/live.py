"""Badge counts and tag counts that follow a stream of catalog changes.

A document's last row is kept in a table beside the counts. A change emits signed rows, its
former row with -1 and its new row with +1, so counts are sums of signs and a document is
never counted twice, however often its status or tags change. Each batch writes only the last
rows of its own documents and the sums of its own changes; a manifest names the folders that
make the current answer, and many small folders are folded into one now and then. A batch
that is run again replaces its own folders.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import discard, materialize
from ..sources.snapshots import Snapshots

KINDS = ("syllabus", "notes", "assign", "other")
COUNTS = ("all", *KINDS, "processing", "failed")
FOLDERS = 20  # folders of changes before they are folded into one
_SCHEMA = {"counts": "kind string, n long", "tags": "tag string, n long"}
_ROW = "struct<version:bigint,status:string,doc_type:string,tags:string>"


def catalog_rows(rows: DataFrame, version: str = "updated") -> DataFrame:
    """(doc_id, row): catalog rows in the form in which they are compared, the version first. Rows without
    an id or a version are left out."""
    at = F.col(version)
    if rows.schema[version].dataType.simpleString().startswith("timestamp"):
        at = F.unix_micros(at.cast("timestamp"))
    row = F.struct(at.cast("bigint").alias("version"), F.coalesce("status", F.lit("")).alias("status"),
                   F.coalesce("doc_type", F.lit("")).alias("doc_type"), F.coalesce(F.to_json("tags"), F.lit("[]")).alias("tags"))
    return rows.select("doc_id", row.alias("row")).where("doc_id IS NOT NULL AND row.version IS NOT NULL")


def newer_rows(rows: DataFrame, last: DataFrame) -> DataFrame:
    """(doc_id, old, row) of the documents whose row in `rows` is newer than that in `last`, both (doc_id, row).

    The version orders the rows of a document (a timestamp or a number), of equal versions the
    greatest row counts. Of `last` only the documents of `rows` are exchanged; when these are
    few, Spark sends them to the tasks that read it.
    """
    known = last.join(rows.select("doc_id"), "doc_id", "left_semi")
    both = rows.select("doc_id", F.lit(None).cast(_ROW).alias("old"), "row").unionByName(
        known.select("doc_id", F.col("row").alias("old"), F.lit(None).cast(_ROW).alias("row")))
    newest = both.groupBy("doc_id").agg(F.max("old").alias("old"), F.max("row").alias("row"))
    return newest.where("row IS NOT NULL AND (old IS NULL OR row > old)")


def signed_rows(newer: DataFrame) -> DataFrame:
    """Signed rows (doc_id, sign, status, doc_type, tags) of (doc_id, old, row). The status "deleted" only
    takes the former row back; a row that differs by its version alone changes nothing."""
    what = lambda c: F.struct(f"{c}.status", f"{c}.doc_type", f"{c}.tags")
    signs = F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("r")), F.struct(F.lit(1).alias("sign"), F.col("row").alias("r")))
    both = newer.where(F.col("old").isNull() | (what("old") != what("row"))).select("doc_id", F.inline(signs))
    return both.where("r IS NOT NULL AND r.status <> 'deleted'").select(
        "doc_id", "sign", "r.status", "r.doc_type", F.from_json("r.tags", "array<string>").alias("tags"))


def count_changes(changes: DataFrame) -> DataFrame:
    """(kind, n): what signed rows add to each badge count of A1."""
    kind = F.coalesce(F.nullif("doc_type", F.lit("")), F.lit("other"))
    kinds = (F.when(F.col("status") == "completed", F.array(F.lit("all"), kind))
             .when(F.col("status").isin("processing", "failed"), F.array("status")))
    return changes.select("sign", F.explode(kinds).alias("kind")).where(F.col("kind").isin(*COUNTS)).groupBy("kind").agg(F.sum("sign").alias("n"))


def tag_changes(changes: DataFrame) -> DataFrame:
    """(tag, n): what signed rows add to each tag's count of A2."""
    return changes.where("status = 'completed'").select("sign", F.explode("tags").alias("tag")).groupBy("tag").agg(F.sum("sign").alias("n"))


def save_changes(changes: DataFrame, batch: int, out: str, folders: int = FOLDERS, keep: int = 2, last: DataFrame | None = None) -> None:
    """Adds one batch of signed rows to the live tables under `out`, and with them the last rows (doc_id, row)
    of its documents; a batch that is there already is left alone."""
    shots = Snapshots(changes.sparkSession, out)
    now = shots.read()
    if now.get("batch", -1) >= batch:
        return
    tables = dict(now["tables"])

    def put(name, rows, schema, total, real="true"):
        have = tables.get(name, [])
        if len(have) >= folders:
            before = shots.table(name, now, schema)
            rows, have = before.union(rows).groupBy(before.columns[0]).agg(total), []
        folder = f"{name}/b{batch}"
        rows.where(real).write.mode("overwrite").parquet(f"{shots.root}/{folder}")
        tables[name] = [*have, folder]

    changes = materialize(changes)
    for name, sums in (("counts", count_changes(changes)), ("tags", tag_changes(changes))):
        put(name, sums, _SCHEMA[name], F.sum("n").alias("n"), "n <> 0")
    if last is not None:
        put("last", last, last.schema, F.max("row").alias("row"))
    shots.commit({"tables": tables, "batch": batch})
    shots.vacuum(keep)
    discard(changes)


def follow(rows: DataFrame, batch: int, out: str, version: str = "updated") -> None:
    """Adds one batch of catalog rows to the live tables under `out`."""
    shots = Snapshots(rows.sparkSession, out)
    now = shots.read()
    if now.get("batch", -1) >= batch:
        return
    # written, so that Spark knows how many documents the batch has
    new = materialize(catalog_rows(rows, version).groupBy("doc_id").agg(F.max("row").alias("row")))
    newer = materialize(newer_rows(new, shots.table("last", now, new.schema)))
    save_changes(signed_rows(newer), batch, out, last=newer.select("doc_id", "row"))
    discard(new, newer)


def write_live(stream: DataFrame, out: str, checkpoint: str, version: str = "updated", trigger: dict | None = None) -> StreamingQuery:
    """Keeps the live tables under `out` current, every five seconds unless told otherwise."""
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"})).foreachBatch(lambda df, n: follow(df, n, out, version)).start()
    )


def live_counts(spark: SparkSession, out: str) -> DataFrame:
    """The current row of badge counts, as A1 gives it."""
    rows = Snapshots(spark, out).table("counts", None, _SCHEMA["counts"])
    return rows.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in COUNTS])


def live_tags(spark: SparkSession, out: str) -> DataFrame:
    """The current tag counts, as A2 gives them."""
    rows = Snapshots(spark, out).table("tags", None, _SCHEMA["tags"])
    return rows.groupBy("tag").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.col("n").desc(), "tag")
