"""Retrieval quality of ranked answers against known relevant documents."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


BLOCK = 256  # short queries that are tried on a text at once


def verbatim_documents(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id) of documents whose text holds the query's text, for query tables of any size.

    What stands between the first and the last blank of a query are whole blank-separated
    words of every text that holds it. The rarest of them finds the candidates, which are then
    compared as texts. Queries without such a word are tried on every text, in blocks of bounded size.
    Empty queries are left out.
    """
    asked = materialize(queries.where(F.length("text") > 0).select("query_id", "text").distinct())
    inner = F.filter(F.slice(F.split("text", " "), 2, F.greatest(F.size(F.split("text", " ")) - 2, F.lit(0))), lambda w: w != "")
    words = materialize(asked.select("query_id", F.explode(F.array_distinct(inner)).alias("word")))
    held = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    held = materialize(held.join(words.select("word").distinct(), "word", "left_semi"))
    often = held.groupBy("word").agg(F.count("*").alias("df"))
    ranked = words.join(often, "word", "left").groupBy("query_id").agg(
        F.min_by("word", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("word"))
    pairs = materialize(ranked.join(held, "word").select("query_id", "doc_id"))
    texts = docs.select("doc_id", F.col("text").alias("_whole"))
    found = texts.join(pairs, "doc_id").join(asked, "query_id").where(F.contains("_whole", F.col("text"))).select("query_id", "doc_id")
    short = materialize(asked.join(words.select("query_id").distinct(), "query_id", "left_anti"))
    n_blocks = -(-2 * short.count() // BLOCK)
    for k in range(n_blocks):
        block = short.where(F.pmod(F.xxhash64("query_id", "text"), F.lit(n_blocks)) == k).agg(F.collect_list(F.struct("query_id", "text"))).scalar()
        beside = docs.select("doc_id", "text", block.alias("asked"))
        hits = beside.select("doc_id", F.explode(F.filter("asked", lambda q: F.contains(F.col("text"), q["text"]))).alias("q"))
        found = found.union(hits.select("q.query_id", "doc_id"))
    return found


def retrieval_quality(ranks: DataFrame, relevant: DataFrame, depth: int = 10) -> DataFrame:
    """One row: queries that have a relevant document, recall at 1 and at `depth` (a query counts
    if any of its documents is found) and the mean reciprocal rank down to `depth`.

    `ranks` holds (query_id, doc_id, rank), `relevant` (query_id, doc_id).
    """
    best = ranks.join(relevant.distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("best"))
    each = relevant.select("query_id").distinct().join(best, "query_id", "left")
    found = F.col("best") <= depth
    return each.agg(
        F.count("*").alias("n_queries"),
        F.round(F.avg(F.coalesce((F.col("best") == 1).cast("double"), F.lit(0.0))), 6).alias("recall_1"),
        F.round(F.avg(F.coalesce(found.cast("double"), F.lit(0.0))), 6).alias("recall_n"),
        F.round(F.avg(F.when(found, 1 / F.col("best")).otherwise(0.0)), 6).alias("mrr"))
