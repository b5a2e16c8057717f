"""From documents to corpus tables in one plan."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.hooks import Encoder, hash_encoder, outcome, summarize
from ..functions.tags import doc_type
from ..functions.text import empty_entities, head, lead_and_findings, normalize_text
from ..operators.chunking import cap_chunks, chunk_pages, number_chunks
from ..operators.classify import classify, label_union
from ..operators.keywords import content_keywords, document_tags
from ..operators.lexical import build_postings
from ..operators.paging import pages_summary, paginate_text
from ..operators.vectors import finite_vectors
from ..session import materialize


@dataclass
class IngestOptions:
    """Hooks and limits of an ingest; None means no model or no limit.

    `sample_pages` and `classify_chars` bound what the metadata steps read; by default
    they read whole texts.
    """
    encoder: Encoder = hash_encoder
    keyword_encoder: Encoder | None = None
    summarizer: Encoder | None = None
    stemmer: Encoder | None = None
    nfkc: Encoder | None = None
    model_version: str = "hash-64"
    max_chunks: int | None = None
    summary_words: int | None = None
    sample_pages: int | None = None
    classify_chars: int | None = None
    keywords: object = field(default=content_keywords)


def classify_text(docs: DataFrame, dims: DataFrame, cats: DataFrame, encoder: Encoder,
                  head_chars: int | None = None) -> DataFrame:
    """C1 with the text and the label names encoded by the same hook. A text that a guarded hook fails
    on has no classes; a label name that it fails on is no label."""
    doc_vecs = docs.select("doc_id", outcome(encoder, head("text", head_chars))["value"].alias("embedding"))
    labels = cats.select("dimension_id", F.col("name").alias("label"), outcome(encoder, F.col("name"))["value"].alias("embedding"))
    return classify(doc_vecs, dims, labels)


def document_metadata(docs: DataFrame, dims: DataFrame, cats: DataFrame,
                      options: IngestOptions | None = None) -> DataFrame:
    """M7: (doc_id, summary, tags, classifications, key_findings, entities)."""
    o = options or IngestOptions()
    none, no_map = F.array().cast("array<string>"), F.create_map().cast("map<string,array<string>>")
    tags = document_tags(docs, label_union(cats), o.keyword_encoder, keywords=o.keywords)
    classes = classify_text(docs, dims, cats, o.encoder, o.classify_chars)
    shown = docs.withColumn("_m", lead_and_findings("text"))
    summary = F.col("_m.summary") if o.summarizer is None else summarize(F.col("text"), o.summarizer, o.summary_words)
    return (
        shown.select("doc_id", summary.alias("summary"), F.col("_m.key_findings").alias("key_findings"), empty_entities().alias("entities"))
        .join(classes, "doc_id", "left").join(tags, "doc_id", "left")
        .withColumns({"classifications": F.coalesce("classifications", no_map), "tags": F.coalesce("tags", none)})
    )


def ingest(files: DataFrame, dims: DataFrame, cats: DataFrame, options: IngestOptions | None = None) -> dict[str, DataFrame]:
    """Corpus tables of a batch of (doc_id, filename, file_size_bytes, upload_date, text).

    A document without text becomes a failed catalog row and appears in no other table; it
    does not disturb the others. So does one with a `reason` (an optional column), which then
    is its message, and one whose chunks a guarded encoder (functions.hooks.guarded) fails on.
    """
    o = options or IngestOptions()
    reason = F.col("reason") if "reason" in files.columns else F.lit(None).cast("string")
    files = files.withColumn("reason", reason).withColumn("text", F.when(F.col("reason").isNull(), F.col("text")))
    # Pages, metadata and encoded chunks feed several tables: each is computed once and
    # written to the shared folder.
    pages = materialize(paginate_text(files.select("doc_id", normalize_text("text", o.nfkc).alias("text"))))
    whole = pages_summary(pages, o.sample_pages or 3)
    body = whole.join(files.select("doc_id", "filename"), "doc_id").select(
        "doc_id", "filename", F.col("sample" if o.sample_pages else "text").alias("text"))
    meta = materialize(document_metadata(body, dims, cats, o))
    chunks = chunk_pages(pages)
    if o.max_chunks is not None:
        chunks = cap_chunks(chunks, o.max_chunks)
    tried = chunks.withColumn("_r", outcome(o.encoder, F.col("text")))
    if getattr(o.encoder, "guarded", False):
        tried = materialize(tried)
        errors = materialize(tried.groupBy("doc_id").agg(F.min("_r.error").alias("_error")).where("_error IS NOT NULL"))
        pages, meta, whole, tried = (df.join(errors, "doc_id", "left_anti") for df in (pages, meta, whole, tried))
        files = files.join(errors, "doc_id", "left").withColumn("reason", F.coalesce("reason", "_error")).drop("_error")
    failed = F.col("page_count").isNull()
    catalog = (
        files.select("doc_id", "filename", "file_size_bytes", "upload_date", "reason")
        .join(whole.select("doc_id", "page_count"), "doc_id", "left")
        .join(meta, "doc_id", "left")
        .select(
            "doc_id", "filename", "file_size_bytes", F.coalesce("page_count", F.lit(0)).alias("page_count"),
            "summary", "tags", "classifications", "key_findings", "entities",
            doc_type("tags", "classifications").alias("doc_type"),
            F.when(failed, "failed").otherwise("completed").alias("status"),
            F.coalesce("reason", F.when(failed, K.NO_TEXT_MESSAGE)).alias("error_message"), "upload_date",
        )
    )
    doc_text = (
        whole.select("doc_id", "text").join(files.select("doc_id", "filename"), "doc_id")
        .join(meta.select("doc_id", F.array_join("tags", " ").alias("tags"), "summary"), "doc_id")
    )
    tried = tried.withColumn("embedding", F.col("_r.value")).drop("_r")
    encoded = materialize(number_chunks(finite_vectors(tried), None))
    return {
        "catalog": catalog,
        "doc_text": doc_text,
        "pages": pages,
        "chunks": encoded.select("chunk_id", "doc_id", "chunk_no", "page", "text"),
        "vectors": encoded.select("chunk_id", "doc_id", "page", "embedding", F.lit(o.model_version).alias("model_version")),
        "postings": build_postings(doc_text, o.stemmer),
    }


def searchable(tables: dict[str, DataFrame]) -> DataFrame:
    """Vectors with their chunk's text, as `hybrid_search` shows it."""
    return tables["vectors"].join(tables["chunks"].select("chunk_id", "text"), "chunk_id")


