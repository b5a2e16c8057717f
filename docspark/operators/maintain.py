"""Table maintenance: upserts, deletes, resets, re-tagging and re-classification.

Operators return new tables; nothing is changed in place. Documents are one row a key in
catalog and text, many rows a key in pages, chunks, vectors and postings.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fallback_summary, is_blank, short_summary
from .catalog import docs_with_text, needs_classification, needs_retag
from .keywords import content_keywords, document_tags, rule_based_tags

CORPUS_TABLES = ("catalog", "doc_text", "pages", "chunks", "vectors", "postings", "progress")


def upsert(target: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """All target rows of a changed key give way to its new rows."""
    return target.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def update_columns(target: DataFrame, changes: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """U1 for some columns: rows with a change take its values, nulls included. Of several changes
    of one key the greatest, written as JSON, counts."""
    values = F.struct(*columns)
    one = changes.groupBy(key).agg(F.max_by(values, F.to_json(values)).alias("c")).select(key, "c.*")
    new = one.select(key, F.lit(True).alias("_changed"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = target.join(new, key, "left")
    return joined.select(*[
        F.when(F.col("_changed"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in target.columns
    ])


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the given documents."""
    gone = ids.select("doc_id").distinct()
    return {name: df.join(gone, "doc_id", "left_anti") for name, df in tables.items()}


def reset_corpus(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Corpus tables emptied, other tables (the taxonomy) as they are."""
    return {n: df.filter(F.lit(False)) if n in CORPUS_TABLES else df for n, df in tables.items()}


def retag(docs: DataFrame, doc_text: DataFrame, force: bool = False, encoder=None,
          keywords=content_keywords) -> tuple[DataFrame, DataFrame]:
    """(catalog, changes): rule-based tags and the lead summary of P3 rows."""
    todo = docs_with_text(needs_retag(docs, force).select("doc_id", "filename"), doc_text)
    tags = rule_based_tags(todo, encoder=encoder, keywords=keywords)
    changes = todo.select("doc_id", fallback_summary("text").alias("summary")).join(tags, "doc_id")
    return update_columns(docs, changes, ["tags", "summary"]), changes


def reclassify(docs: DataFrame, doc_text: DataFrame, labels: DataFrame, classifier, force: bool = False,
               limit: int | None = None, signature: str | None = None, encoder=None,
               keywords=content_keywords) -> tuple[DataFrame, DataFrame]:
    """(catalog, changes): new classifications, tags and summary of P4 rows.

    `classifier` maps (doc_id, filename, text) rows to (doc_id, classifications). Blank
    texts are passed over. With a signature the changed rows carry it.
    """
    todo = docs_with_text(
        needs_classification(docs, force, limit).select("doc_id", "filename"), doc_text
    ).filter(~is_blank("text"))
    none, no_map = F.array().cast("array<string>"), F.create_map().cast("map<string,array<string>>")
    changes = (
        todo.select("doc_id", short_summary("text").alias("summary"))
        .join(classifier(todo), "doc_id", "left")
        .join(document_tags(todo, labels, encoder=encoder, keywords=keywords), "doc_id", "left")
        .withColumns({"classifications": F.coalesce("classifications", no_map), "tags": F.coalesce("tags", none)})
    )
    columns = ["classifications", "tags", "summary"]
    if signature is not None:
        changes = changes.withColumn("classifier_signature", F.lit(signature))
        if "classifier_signature" not in docs.columns:
            docs = docs.withColumn("classifier_signature", F.lit(None).cast("string"))
        columns.append("classifier_signature")
    return update_columns(docs, changes, columns), changes
