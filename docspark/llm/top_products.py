"""Exact top-k by inner product, bucketed by length (LEMP; Teflioudi, Gemulla, Mykytiuk, 2015).

Vectors are range-partitioned by length and packed into buckets of neighbours in length.
For a query and a bucket, the k-th best product so far over the query's length and the
bucket's greatest length is a *local cosine threshold*: above 1 the bucket is skipped; when
it is high, only vectors whose values in the query's largest coordinates lie in the
intervals that the threshold allows are verified (coordinate pruning); else the bucket's
vectors are verified down to the length that can still reach the k-th best (length pruning).

Queries are cut into blocks, and each block meets each group of buckets in a task of its
own. The longest bucket of all, which every task gets, seeds the thresholds; queries and
groups have a bounded size, so no task grows with the tables.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.session import materialize

BUCKET = 1024   # vectors a bucket
GROUP = 16_384  # vectors a group
BLOCK = 4096    # queries a block
COORDINATES = 4
COSINE_FOR_COORDINATES = 0.6
SLACK = 1e-9    # on lengths and cosines, which are rounded; products are exact integers

_HITS = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
_HITS_DDL = "query_id long, vec_id long, score long"


def _side(t: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    t = t.combine_chunks()
    vecs = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0)
    return t.column("id").to_numpy(), vecs.reshape(-1, dim)


class _Bucket:
    """Vectors by falling length, with the order of each coordinate made when first asked for."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray):
        length = np.sqrt((vecs.astype(np.float64) ** 2).sum(1))
        order = np.lexsort((ids, -length))
        self.ids, self.vecs, self.length = ids[order], vecs[order], length[order]
        self.unit = self.vecs / np.maximum(self.length, 1e-300)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def within(self, c: int, low: float, high: float) -> np.ndarray:
        if c not in self.sorted:
            order = np.argsort(self.unit[:, c], kind="stable")
            self.sorted[c] = order, self.unit[order, c]
        order, values = self.sorted[c]
        return order[np.searchsorted(values, low - SLACK):np.searchsorted(values, high + SLACK, "right")]

    def candidates(self, unit_query: np.ndarray, focus: np.ndarray, local: float, reach: float) -> np.ndarray | slice:
        """Rows that can reach the threshold; `reach` is the least length that can."""
        if local >= COSINE_FOR_COORDINATES:
            rest = np.sqrt(max(0.0, 1 - local * local))
            best = None
            for c in focus:
                x = unit_query[c]
                spread = rest * np.sqrt(max(0.0, 1 - x * x))
                found = self.within(int(c), x * local - spread if x >= -local else -1.0, x * local + spread if x <= local else 1.0)
                if best is None or len(found) < len(best):
                    best = found
            return best
        return slice(0, int(np.searchsorted(-self.length, -(reach - SLACK), "right")))


def _search(qids: np.ndarray, queries: np.ndarray, seeds: np.ndarray, buckets: list[_Bucket], k: int):
    """The k best of `buckets` for every query, below its seed left out."""
    lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    tops = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(qids)
    for bucket in sorted(buckets, key=lambda b: -b.length[0]):
        for i, q in enumerate(queries):
            ids, scores = tops[i]
            least = max(float(seeds[i]), float(scores[-1]) if len(scores) >= k else -np.inf)
            if np.isfinite(least) and least > 0 and lengths[i] > 0:
                local = least / (lengths[i] * max(bucket.length[0], 1e-300)) - SLACK
                if local > 1:
                    continue
                unit = q / lengths[i]
                rows = bucket.candidates(unit, np.argsort(-np.abs(unit))[:COORDINATES], local, least / lengths[i])
            else:
                rows = slice(None)
            got, who = bucket.vecs[rows] @ q, bucket.ids[rows]
            keep = (who != qids[i]) & (got >= least)
            got, who = got[keep].astype(np.int64), who[keep]
            if not len(got):
                continue
            ids, scores = np.concatenate([ids, who]), np.concatenate([scores, got])
            best = np.lexsort((ids, -scores))[:k]
            tops[i] = ids[best], scores[best]
    for i, (ids, scores) in enumerate(tops):
        for a, b in zip(ids.tolist(), scores.tolist()):
            yield int(qids[i]), a, b


def _seeds(qids: np.ndarray, queries: np.ndarray, head_ids: np.ndarray, head: np.ndarray, k: int) -> np.ndarray:
    """A product that at least k rows of the longest bucket reach, for every query."""
    scores = queries @ head.T
    scores[qids[:, None] == head_ids[None, :]] = -np.inf
    if scores.shape[1] < k:
        return np.full(len(qids), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "vec") -> DataFrame:
    """For every row of `queries` the k rows of `vectors` with the greatest inner product.

    Both tables hold an id and a vector of whole numbers of one length (products are summed
    in doubles, so they must stay below 2**53). Gives query_id, rank from 1, vec_id and
    score; ties go to the smaller id, a row never answers itself, and fewer than k rows give
    all of them. Null ids, vectors that are null, empty or hold null take no part; rows that
    repeat an id count once, with their greatest vector; another length is an error. Other
    columns are ignored; an empty table on either side gives an empty result.
    """
    def clean(df):
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
        rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull()))
        return rows.groupBy("id").agg(F.max("vec").alias("vec"))

    vecs = clean(vectors).withColumn("length", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))
    vecs, asked = materialize(vecs), materialize(clean(queries))
    sizes = vecs.select(F.size("vec").alias("n")).union(asked.select(F.size("vec"))).agg(F.min("n"), F.max("n")).first()
    n, n_asked = vecs.count(), asked.count()
    if not n or not n_asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} components")
    dim = sizes[0]
    by_length = [F.desc("length"), F.col("id")]
    grouped = vecs.repartitionByRange(-(-n // GROUP), *by_length).select("id", "vec", F.spark_partition_id().alias("grp"))
    grouped = materialize(grouped)
    n_groups, n_blocks = grouped.agg(F.max("grp")).first()[0] + 1, -(-n_asked // BLOCK)
    head_rows = vecs.orderBy(*by_length).limit(BUCKET).select("id", "vec").collect()
    head_ids, head = np.array([r[0] for r in head_rows]), np.array([r[1] for r in head_rows], np.float64)
    left = asked.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"),
                        F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("grp"))
    right = grouped.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "grp")

    def search(key, q, v):
        (qids, queries), (ids, vecs) = _side(q, dim), _side(v, dim)
        found = []
        if len(qids) and len(ids):
            order = np.argsort(-(vecs * vecs).sum(1), kind="stable")
            buckets = [_Bucket(ids[x], vecs[x]) for x in np.split(order, range(BUCKET, len(order), BUCKET))]
            found = _search(qids, queries, _seeds(qids, queries, head_ids, head, k), buckets, k)
        found = list(zip(*found)) or [[], [], []]
        return pa.table([pa.array(x, type=t) for x, (_, t) in zip(found, _HITS)], names=[c for c, _ in _HITS])

    hits = left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInArrow(search, _HITS_DDL)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
