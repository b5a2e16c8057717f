"""Rank fusion, candidate pool, metadata, reranking and the final cut."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.hooks import overlap_scorer

HIT_METADATA = ["filename", "summary", "tags", "key_findings", "entities"]


def fuse_ranks(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """Chunk candidates with their document's keyword rank; a document without one gets
    the query's number of keyword hits plus 60. A query's ranks, at most the keyword top, are
    one map, so that they are computed and joined once."""
    ranks = keyword.groupBy("query_id").agg(
        F.map_from_entries(F.collect_list(F.struct("doc_id", "kw_rank"))).alias("ranks"))
    penalty = F.greatest(F.coalesce(F.size("ranks"), F.lit(0)), F.lit(0)) + K.RRF_K
    return (
        semantic.join(ranks, "query_id", "left")
        .withColumn("kw_rank", F.coalesce(F.try_element_at("ranks", F.col("doc_id")), penalty))
        .drop("ranks")
    )


def rrf_score(kw_rank: Column, sem_rank: Column, kw_weight: float = K.RRF_KW_WEIGHT,
              sem_weight: float = K.RRF_SEM_WEIGHT, k: int = K.RRF_K) -> Column:
    """Rounded to six decimals before anything is sorted by it."""
    return F.round(kw_weight / (k + kw_rank) + sem_weight / (k + sem_rank), 6)


def rrf(keyword: DataFrame, semantic: DataFrame, **weights) -> DataFrame:
    fused = fuse_ranks(keyword, semantic)
    return fused.withColumn("score", rrf_score(F.col("kw_rank"), F.col("sem_rank"), **weights))


def pool_size(limit: int, most: int = K.RERANK_MOST) -> int:
    """Candidates a query that go on to the reranker: three times the limit, 15 at least, `most`
    at most, but never fewer than the limit."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return max(limit, min(max(limit * 3, 15), most))


def rerank_pool(fused: DataFrame, limit: int = 5, most: int = K.RERANK_MOST) -> DataFrame:
    """Best candidates of each query in score order, ties by semantic rank. A chunk
    occurs once: its best-placed row is kept."""
    shown = [c for c in ("page",) if c in fused.columns]
    first = F.min_by(F.struct("doc_id", "similarity", "sem_rank", "kw_rank", "score", *shown), F.col("sem_rank"))
    unique = fused.groupBy("query_id", "chunk_id").agg(first.alias("f")).select("query_id", "chunk_id", "f.*")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "sem_rank")
    return unique.withColumn("fused_rank", F.row_number().over(w)).filter(F.col("fused_rank") <= pool_size(limit, most))


def attach_metadata(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits whose document is not in the catalog disappear, after the pool was cut."""
    return hits.join(docs.select("doc_id", *[c for c in HIT_METADATA if c in docs.columns]), "doc_id")


def rerank(hits: DataFrame, scorer=overlap_scorer, query: str = "query", text: str = "text") -> DataFrame:
    """Joint (query, text) scores reorder the hits of queries with more than one.

    The scorer sees the pool of a query (pool_size) and no more. Hits it cannot score keep
    their fused order behind the others, whatever sign scores have.
    """
    whole = Window.partitionBy("query_id")
    scored = hits.withColumn("n_hits", F.count("*").over(whole)).withColumn(
        "ce_score", F.when(F.col("n_hits") > 1, F.round(scorer(F.col(query), F.col(text)), 4)))
    order = whole.orderBy(F.col("ce_score").desc_nulls_last(), "fused_rank")
    return scored.withColumn("rank", F.row_number().over(order)).drop("n_hits")


def fused_order(hits: DataFrame) -> DataFrame:
    """Ranks without a reranker; dense from 1 after the metadata join."""
    w = Window.partitionBy("query_id").orderBy("fused_rank")
    return hits.withColumn("rank", F.row_number().over(w))


def top_hits(ranked: DataFrame, limit: int = 5) -> DataFrame:
    """T2."""
    pool_size(limit)
    return ranked.filter(F.col("rank") <= limit)


def present_hits(hits: DataFrame) -> DataFrame:
    """Match percentage and the first three tags."""
    return hits.withColumns({
        "relevancy": F.round(F.col("similarity") * 100).cast("int"),
        "shown_tags": F.slice("tags", 1, 3),
    })
