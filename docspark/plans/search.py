"""Hybrid search: keyword and vector candidates, fused, looked up, reranked."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.hooks import Encoder
from ..functions.text import is_blank
from ..operators import fusion, lexical, vectors as V
from ..operators.keywords import expand_query
from ..session import materialize


def hybrid_search(
    queries: DataFrame,
    docs: DataFrame,
    doc_text: DataFrame,
    vectors: DataFrame,
    limit: int = 5,
    encoder: Encoder | None = None,
    stopwords: Iterable[str] = K.STOPWORDS,
    stemmer: Encoder | None = None,
    expand: bool = False,
    scorer=None,
    postings: DataFrame | None = None,
    stats: DataFrame | None = None,
    kw_weight: float = K.RRF_KW_WEIGHT,
    sem_weight: float = K.RRF_SEM_WEIGHT,
    keyword_top: int = K.KEYWORD_TOP,
    semantic_top: int = K.SEMANTIC_TOP,
    rerank_most: int = K.RERANK_MOST,
    headers: DataFrame | None = None,
    parts: DataFrame | None = None,
) -> DataFrame:
    """The first `limit` hits of every query.

    `queries` has (query_id, text) and, unless an encoder is given, `embedding`; `vectors`
    has (chunk_id, doc_id, embedding) and optionally page and text. A blank query or an
    empty corpus gives no rows. `postings` and `stats` are a stored index (build_postings,
    doc_stats), or `postings`, `headers` and `parts` one that was written by bucket (read_index); without them the texts are tokenised for this call. `keyword_top` and
    `semantic_top` are the candidates a query on either side (the semantic side has at least
    the pool's number), `rerank_most` bounds the pool unless the limit is greater.
    """
    pool_rows = fusion.pool_size(limit, rerank_most)
    queries = queries.filter(~is_blank("text"))
    if encoder is not None:
        queries = materialize(V.encode_distinct(queries, encoder))  # used three times
    phrases = expand_query(queries, stopwords) if expand else None
    keyword = lexical.keyword_ranks(queries, doc_text, stopwords, stemmer, phrases, postings, stats, keyword_top,
                                    headers, parts)
    shown = tuple(c for c in ("page",) if c in vectors.columns)
    semantic = V.vector_topk(queries, vectors, max(semantic_top, pool_rows), keep=("doc_id", *shown))
    fused = fusion.rrf(keyword, semantic, kw_weight=kw_weight, sem_weight=sem_weight)
    # pool_rows a query at most; written out, so that Spark knows how small they are and
    # looks them up in the catalog and the chunks without shuffling either.
    pool = materialize(fusion.rerank_pool(fused, limit, rerank_most))
    hits = fusion.attach_metadata(pool, docs)
    if "text" in vectors.columns:
        hits = hits.join(vectors.select("chunk_id", "text"), "chunk_id")
    if scorer is None:
        ranked = fusion.fused_order(hits)
    else:
        ranked = fusion.rerank(hits.join(queries.select("query_id", F.col("text").alias("query")), "query_id"), scorer)
    return fusion.top_hits(ranked, limit)
