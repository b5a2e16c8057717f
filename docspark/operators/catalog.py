"""Catalog filters, listings, counts and roll-ups."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.tags import categorise_tags, doc_type_of
from ..functions.text import collapse, ellipsis, is_blank, key_insights, title_case
from ..session import materialize


def newest_first(docs: DataFrame) -> DataFrame:
    """T3."""
    return docs.orderBy(F.col("upload_date").desc(), "doc_id")


def newest_places(docs: DataFrame) -> DataFrame:
    """T3 with `place`, from 1. Rows are sorted in ranges; a row's place is its number in its task after
    the rows of the tasks before it, so no task sees more than its range."""
    placed = materialize(newest_first(docs).withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    sizes = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))  # a row a task
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(sizes.select("_task", before.alias("_before")))
    numbered = placed.withColumn("_task", task).join(starts, "_task")
    place = F.col("_at") - F.shiftleft("_task", 33) + F.col("_before") + 1
    return numbered.withColumn("place", place).drop("_at", "_task", "_before")


def list_documents(docs: DataFrame, doc_type: str | None = None, tag: str | None = None,
                   dimension: str | None = None, value: str | None = None) -> DataFrame:
    """The listing, newest first. Empty filters are off; a dimension needs its value. A stored
    type is filtered in the scan, a missing one is derived first."""
    if doc_type:
        docs = docs.filter((F.col("doc_type") == doc_type) | F.col("doc_type").isNull() | (F.col("doc_type") == ""))
    out = docs.withColumn("doc_type", F.coalesce(F.nullif("doc_type", F.lit("")), doc_type_of(
        F.coalesce("tags", F.array().cast("array<string>")))))
    if doc_type:
        out = out.filter(F.col("doc_type") == doc_type)
    if tag:
        out = out.filter(F.array_contains("tags", tag))
    if dimension and value:
        out = out.filter(F.array_contains(F.try_element_at("classifications", F.lit(dimension)), value))
    return newest_first(out.withColumn("tag_categories", categorise_tags("tags")))


def completed_only(docs: DataFrame) -> DataFrame:
    """P2."""
    return docs.filter(F.col("status") == "completed")


def needs_retag(docs: DataFrame, force: bool = False) -> DataFrame:
    """Every completed document when forced; otherwise placeholder tags or summary, in
    whatever status."""
    if force:
        return completed_only(docs)
    tags = F.col("tags")
    placeholder = (F.size(tags) == 1) & tags[0].isin(K.PLACEHOLDER_TAGS)
    return docs.filter(
        tags.isNull() | (F.size(tags) == 0) | placeholder
        | F.col("summary").isNull() | (F.col("summary") == "") | F.col("summary").like("AI summary%"))


def needs_classification(docs: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
    """Completed documents without classifications; blank texts are passed over after
    the optional first-n cut."""
    out = completed_only(docs)
    if not force:
        out = out.filter(F.coalesce(F.size("classifications"), F.lit(0)) <= 0)
    if limit:
        out = out.orderBy("doc_id").limit(limit)
    return out.filter(~is_blank("text")) if "text" in docs.columns else out


def stale_processing(docs: DataFrame, now: dt.datetime | Column | None = None, hours: int = 2) -> DataFrame:
    """P5: the catalog with abandoned uploads marked failed."""
    now = F.current_timestamp() if now is None else (now if isinstance(now, Column) else F.lit(now))
    old = (F.col("status") == "processing") & (F.col("upload_date") < now - F.expr(f"interval {hours} hours"))
    return docs.withColumns({
        "error_message": F.when(old, K.STALE_MESSAGE).otherwise(F.col("error_message")),
        "status": F.when(old, "failed").otherwise(F.col("status")),
    })


def stale_versions(df: DataFrame, current: str, column: str = "model_version") -> DataFrame:
    """Rows built with another version; an unset version counts as matching."""
    c = F.col(column)
    return df.filter(c.isNotNull() & (c != "") & (c != current))


def retryable(docs: DataFrame) -> DataFrame:
    """Failed and processing rows, queued again."""
    return docs.filter(F.col("status").isin("failed", "processing")).withColumns(
        {"status": F.lit("processing"), "error_message": F.lit(None).cast("string")})


def _list(c) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def present_documents(docs: DataFrame) -> DataFrame:
    """The fields of a list card."""
    size, pages = F.coalesce("file_size_bytes", F.lit(0)), F.coalesce("page_count", F.lit(0))
    size_label = F.when(size > 0, F.concat(F.format_string("%.1f", size / 1024), F.lit(" KB"))).otherwise("")
    page_label = F.when(pages > 0, F.concat(pages.cast("string"), F.when(pages != 1, " pgs").otherwise(" pg"))).otherwise("")
    cls = lambda k: _list(F.try_element_at("classifications", F.lit(k)))
    pills = F.concat(F.slice(cls("subject"), 1, 2), F.slice(cls("methodology"), 1, 1))
    tags = _list(F.col("tags"))
    flat = collapse(F.coalesce("summary", F.lit("")))
    return docs.select(
        "doc_id", "filename",
        size_label.alias("size_label"), page_label.alias("page_label"),
        F.array_join(F.filter(F.array(page_label, size_label), lambda x: x != ""), " · ").alias("meta"),
        F.when(F.size(pills) > 0, pills).otherwise(F.slice(tags, 1, 2)).alias("pills"),
        F.coalesce(F.try_element_at(cls("doc_type"), F.lit(1)), F.lit("")).alias("type_label"),
        F.slice(tags, 1, 3).alias("shown_tags"),
        F.when(F.lower(flat).contains("scifact"), "").otherwise(flat).alias("summary_line"),
        ellipsis(flat, 80, 78).alias("short_summary"),
    )


def docs_with_text(docs: DataFrame, doc_text: DataFrame) -> DataFrame:
    """Every document with its text, '' where there is none."""
    return docs.join(doc_text.select("doc_id", "text"), "doc_id", "left").withColumn(
        "text", F.coalesce("text", F.lit("")))


def document_text(doc_text: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, status) for each requested id; unknown ids are 'missing'."""
    return ids.select("doc_id").join(doc_text.select("doc_id", "text"), "doc_id", "left").withColumn(
        "status", F.when(F.col("text").isNull(), "missing").otherwise("found"))


def document_insights(docs: DataFrame, doc_text: DataFrame, n: int = 5) -> DataFrame:
    """F7 as a report: (doc_id, insights, source) for completed documents."""
    joined = docs_with_text(completed_only(docs).select("doc_id"), doc_text)
    blank = is_blank("text")
    return joined.select(
        "doc_id",
        F.when(blank, F.array().cast("array<string>")).otherwise(key_insights("text", n)).alias("insights"),
        F.when(blank, "none").otherwise("extracted").alias("source"))


def ingest_status(docs: DataFrame, progress: DataFrame, ids: DataFrame) -> DataFrame:
    """Status of each requested id; live progress overrides the defaults."""
    st = F.col("status")
    return (
        ids.select("doc_id").join(docs.select("doc_id", "status", "error_message"), "doc_id", "left")
        .join(progress.select("doc_id", "step", "pct", "detail"), "doc_id", "left")
        .select(
            "doc_id", F.coalesce(st, F.lit("missing")).alias("status"), "error_message",
            F.when(st.isNull(), None).otherwise(F.coalesce(
                "step", F.when(st == "processing", "queued").otherwise(st))).alias("step"),
            F.when(st.isNull(), None).otherwise(F.coalesce(
                "pct", F.when(st == "completed", 100).otherwise(0))).alias("pct"),
            F.when(st.isNull(), None).otherwise(F.coalesce(
                "detail", F.when(st == "processing", "Waiting to start…").otherwise(""))).alias("detail"),
        )
    )


# --- Counts and roll-ups ------------------------------------------------------

def document_counts(docs: DataFrame) -> DataFrame:
    """A1: one row of badge counts."""
    done = F.col("status") == "completed"
    kind = F.coalesce(F.nullif("doc_type", F.lit("")), F.lit("other"))
    return docs.agg(
        F.count_if(done).alias("all"),
        *[F.count_if(done & (kind == k)).alias(k) for k in ("syllabus", "notes", "assign", "other")],
        F.count_if(F.col("status") == "processing").alias("processing"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def tag_counts(docs: DataFrame) -> DataFrame:
    """A2: tag occurrences over completed documents, most frequent first."""
    return (
        completed_only(docs).select(F.explode("tags").alias("tag"))
        .groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tag")
    )


def _with_labels(rows: DataFrame, dims: DataFrame) -> DataFrame:
    meta = dims.select("dimension_id", "display_name", "dim_order")
    return rows.join(meta, "dimension_id", "left").withColumns({
        "label": F.coalesce("display_name", title_case(F.replace("dimension_id", F.lit("_"), F.lit(" ")))),
        "dim_order": F.coalesce("dim_order", F.lit(99)),
    }).drop("display_name")


def exploded_values(docs: DataFrame, *extra: str) -> DataFrame:
    """(dimension_id, value, ...) of completed documents; A3 and A4 share it."""
    dims = completed_only(docs).select(*extra, F.explode("classifications").alias("dimension_id", "vals"))
    return dims.select(*extra, "dimension_id", F.explode("vals").alias("value"))


def tag_hierarchy(docs: DataFrame, dims: DataFrame, top: int = K.MAX_TAGS_PER_VALUE) -> DataFrame:
    """A3: (dimension_id, label, dim_order, value, value_total, tag, n, place).

    Counts combine before the shuffle; the value total is an aggregate of the counts, not a
    window, and the top-k cut runs in every task before the shuffle by value.
    """
    pairs = exploded_values(docs, "tags").select("dimension_id", "value", F.explode("tags").alias("tag"))
    counts = pairs.groupBy("dimension_id", "value", "tag").agg(F.count("*").alias("n"))
    totals = counts.groupBy("dimension_id", "value").agg(F.sum("n").alias("value_total"))
    w = Window.partitionBy("dimension_id", "value").orderBy(F.col("n").desc(), "tag")
    best = counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)
    return _with_labels(best.join(totals, ["dimension_id", "value"]), dims).orderBy(
        "dim_order", "dimension_id", F.col("value_total").desc(), "value", "place")


def perspectives(docs: DataFrame, dims: DataFrame) -> DataFrame:
    """A4: (dimension_id, label, dim_order, value, n), values by document count."""
    vals = exploded_values(docs).filter(F.col("value").isNotNull() & (F.col("value") != ""))
    counts = vals.groupBy("dimension_id", "value").agg(F.count("*").alias("n"))
    return _with_labels(counts, dims).orderBy("dim_order", "dimension_id", F.col("n").desc(), "value")


def top_values(rows: DataFrame, top: int = 5) -> DataFrame:
    """T4: first values of each dimension and how many more there are."""
    w = Window.partitionBy("dimension_id").orderBy(F.col("n").desc(), "value")
    sizes = rows.groupBy("dimension_id").agg(F.greatest(F.count("*") - top, F.lit(0)).alias("more"))
    return (
        rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)
        .join(sizes, "dimension_id")
    )


def tag_occurrence_totals(hierarchy: DataFrame) -> DataFrame:
    """Categories and shown tags per perspective; one hierarchy row is one shown tag."""
    per_value = hierarchy.groupBy("dimension_id", "value").agg(F.count("*").alias("shown"))
    return per_value.groupBy("dimension_id").agg(F.count("*").alias("n_values"), F.sum("shown").alias("n_tags"))


def corpus_health(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """A5: one row; the chunk count is a scalar subquery."""
    return docs.agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "processing").alias("processing"),
    ).withColumn("chunks", chunks.agg(F.count("*")).scalar())
