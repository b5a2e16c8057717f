"""Engine inputs derived from the test tables; `checks/sql.py` holds the same formulas in SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.tags import doc_type_of
from docspark.functions.text import fallback_summary
from docspark.operators import keywords as KW
from docspark.session import spread

EXTENSIONS = [".pdf", ".docx", ".txt", ".md", ".json", ".exe"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id")


def _source_no():
    return F.substring("source", 4, 9).cast("int")


def filename():
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), _source_no() % 6 + 1)
    return F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), ext)


def named_text(spark, d) -> DataFrame:
    return documents(spark, d).select("doc_id", filename().alias("filename"), "text")


def catalog(spark, d, tags: bool = True, only: DataFrame | None = None) -> DataFrame:
    """The catalog, or its rows of the documents in `only`: of the others no column is derived."""
    docs = documents(spark, d)
    if only is not None:
        docs = docs.join(only.select("doc_id"), "doc_id", "left_semi")
    n = _source_no()
    labels = table(spark, d, "labels")
    special = (
        F.when(n <= 2, "Syllabus").when(n <= 4, "Lecture Notes").when(n <= 7, "Homework")
        .when(n == 8, "Fall 2024").when(n == 9, "Graduate Level")
    )
    none = F.array().cast("array<string>")
    special = F.when(special.isNotNull(), F.array(special)).otherwise(none)
    base = docs.join(labels, "doc_id", "left").select(
        "doc_id", filename().alias("filename"),
        F.octet_length("text").cast("bigint").alias("file_size_bytes"),
        F.ceil(F.length("text") / 2000).cast("int").alias("page_count"),
        fallback_summary("text").alias("summary"),
        F.create_map(
            F.lit("language"), F.array("lang"), F.lit("source"), F.array("source"),
            F.lit("subject"), F.when(F.col("quality") == 1, F.array(F.lit("Readable"), F.upper("lang"))).otherwise(none),
        ).alias("classifications"),
        F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "processing").otherwise("completed").alias("status"),
        F.when(F.col("toxic") == 1, "bad text").alias("error_message"),
        (F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("doc_id") * 60)).alias("upload_date"),
        F.when(n < 15, doc_type_of(special)).alias("doc_type"),
        special.alias("special"),
    )
    if not tags:
        return base.withColumnRenamed("special", "tags")
    words = KW.collect_tags(KW.frequent_words(docs, top=5).select("doc_id", "pos", F.col("phrase").alias("tag")))
    return base.join(words, "doc_id", "left").withColumn("tags", F.concat(F.coalesce("tags", none), "special")).drop("special")


def dimensions(spark) -> DataFrame:
    return spark.createDataFrame(
        [("language", "Language", True, 1), ("source", "Source", False, 2), ("doc_type", "Document Type", True, 3)],
        "dimension_id string, display_name string, is_multi_label boolean, dim_order int")


def categories(spark, d) -> DataFrame:
    docs = documents(spark, d)
    return (
        docs.select(F.lit("language").alias("dimension_id"), F.col("lang").alias("name")).distinct()
        .union(docs.select(F.lit("source"), F.col("source")).distinct())
    )


def queries(spark, d) -> DataFrame:
    """Benchmark texts with the vector of the same number, if there is one."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return b.join(e, "query_id", "left")


def vectors(spark, d) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select(
        v.alias("chunk_id"), (F.floor(v / 3) * 7).cast("bigint").alias("doc_id"), (v % 3 + 1).cast("int").alias("page"),
        "embedding", F.when(F.col("label") == 0, "v0").when(F.col("label") > 1, "v1").alias("model_version"), "label")


def label_vectors(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    cent = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))
    return cent.select(F.explode(F.array(F.lit("topic"), F.lit("best"))).alias("dimension_id"),
                       F.concat(F.lit("t"), F.col("label").cast("string")).alias("label"), "embedding")


def label_dims(spark) -> DataFrame:
    return spark.createDataFrame([("topic", "Topic", True, 1), ("best", "Best", False, 2)],
                                 "dimension_id string, display_name string, is_multi_label boolean, dim_order int")


def doc_vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def conversation_pages(spark, d) -> DataFrame:
    return spread(table(spark, d, "conversations"), "conv_id").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text", "role")


def document_pages(spark, d) -> DataFrame:
    from docspark.operators.paging import paginate_text
    return paginate_text(documents(spark, d))


def event_pages(spark, d) -> DataFrame:
    """Forty events a page, one line an event: tabular pages."""
    line = F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit(" "), "event_type", F.lit(" "), "props")
    return (
        table(spark, d, "events")
        .groupBy(F.floor(F.col("event_id") / 400).alias("doc_id"), (F.floor(F.col("event_id") / 40) % 10).cast("int").alias("page"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    )


def cells(spark, d) -> DataFrame:
    e = F.col("event_id")
    val = F.col("value").cast("decimal(12,2)").cast("string")
    c = F.array(
        F.struct(F.lit(0).alias("col_no"), F.col("event_type").alias("text")),
        F.struct(F.lit(1).alias("col_no"), F.when(F.col("event_type") != "error", val).alias("text")),
        F.struct(F.lit(2).alias("col_no"), F.replace("props", F.lit(": "), F.lit(":\n")).alias("text")),
        F.struct(F.lit(3).alias("col_no"), F.col("event_type").alias("text")),
    )
    return table(spark, d, "events").select(
        F.floor(e / 400).alias("doc_id"), (F.floor(e / 40) % 10).cast("int").alias("page"),
        (F.floor(e / 20) % 2).cast("int").alias("table_no"), (e % 20).cast("int").alias("row_no"),
        F.explode(F.when(F.col("value") > 5, c).otherwise(F.slice(c, 1, 2))).alias("c"),
    ).select("doc_id", "page", "table_no", "row_no", "c.*")


def detections(spark, d) -> DataFrame:
    """Three boxes an event, rows twenty pixels apart with a little skew."""
    e = F.col("event_id")
    texts = F.array("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")), "props")
    y = (e % 40) * 20.0 + F.col("k")
    x = (2 - F.col("k")) * 100.0
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return table(spark, d, "events").select(
        e.alias("event_id"), "value", F.posexplode(texts).alias("k", "text")
    ).select(
        F.floor(e / 400).alias("doc_id"), (F.floor(e / 40) % 10).cast("int").alias("page"),
        (e % 40 * 3 + F.col("k")).cast("int").alias("det_no"), "text",
        F.when(F.col("value") < 5, 0.4).when(F.col("value") < 10, 0.0).otherwise(0.9).alias("score"),
        F.array(corner(0, -6), corner(80, -6), corner(80, 6), corner(0, 6)).alias("poly"))


def blocks(spark, d) -> DataFrame:
    """Lines of a document in two columns, ten rows a page."""
    lines = documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    y = F.floor(F.col("n") % 20 / 2) * 14.0
    x = (F.col("n") % 2) * 300.0
    return lines.select(
        "doc_id", (F.floor(F.col("n") / 20) + 1).cast("int").alias("page"), F.col("n").alias("block_no"),
        x.alias("x0"), y.alias("y0"), (x + 280).alias("x1"), (y + 10 + F.length("text") % 5).alias("y1"), "text",
        F.when(F.length("text") > 1500, 1).otherwise(0).alias("block_type"))


def images(spark, d) -> DataFrame:
    n = F.length("text")
    return conversation_pages(spark, d).select(
        "doc_id", "page", F.lit(1).alias("image_no"), (n * 7 % 3000 + 40).cast("int").alias("width"), (n * 3 % 2000 + 60).cast("int").alias("height"))


def scanned_pages(spark, d) -> DataFrame:
    """Assistant turns have text, user turns are images only."""
    return conversation_pages(spark, d).select(
        "doc_id", "page", F.when(F.col("role") == "assistant", F.col("text")).otherwise("").alias("text"),
        F.lit(600.0 * 800.0).alias("page_area"))


def progress(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("doc_id"), "ts", F.col("event_type").alias("step"),
        F.floor("value").cast("int").alias("pct"), F.col("props").alias("detail"))
