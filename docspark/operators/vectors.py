"""Exact cosine retrieval over vector tables.

Vectors stay where they are: every task scores its own Arrow batches against a block of
queries as one matrix product and passes on only the best k of a query. A query table of any
size is taken block by block, each of bounded size; the vectors are scanned once a block and
never exchanged, and what the tasks pass on is cut to k a query before it is moved.
"""
from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.hooks import Encoder
from ..session import discard, materialize

# Rows of the small side that are shipped to every task at once.
SHIP_ROWS = 4096


def _finite(column: str) -> Column:
    return F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def finite_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose every component is a finite number."""
    return vectors.filter(_finite(column))


def usable_vectors(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Rows with a vector of `dim` finite components."""
    return vectors.filter((F.size(column) == dim) & _finite(column))


def rejected_vectors(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """(reason, n): how many rows usable_vectors leaves out, and why."""
    reason = (F.when(F.col(column).isNull(), "no vector").when(F.size(column) != dim, "other length")
              .when(~_finite(column), "null or not finite"))
    return vectors.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def dimension(vectors: DataFrame, column: str = "embedding") -> int | None:
    """The length that most vectors have, the greater one of equals; None without vectors."""
    sizes = vectors.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("dim")).agg(F.count("*").alias("n"))
    return sizes.agg(F.max_by("dim", F.struct("n", "dim"))).first()[0]


def cosine(a, b):
    """Cosine of two array columns in double precision, a batch at a time; 0 where either has no length, or holds a null."""
    return _cosines()(a, b)


def _cosines(rows: int = 1024):
    @F.arrow_udf(T.DoubleType())
    def cosines(a: pa.Array, b: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def matrix(column):
            """The rows as a matrix, if all are of one length and without nulls."""
            flat, n = column.flatten(), pc.unique(pc.list_value_length(column))
            if column.null_count or flat.null_count or len(n) != 1:
                return None
            return flat.to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)

        def ratio(dot, norm):
            return np.divide(dot, norm, out=np.zeros_like(dot), where=(norm > 0) | np.isnan(norm))

        def single(x, y):
            if x is None or y is None or None in x or None in y:
                return 0.0
            x, y = np.array(x, dtype="float64"), np.array(y, dtype="float64")
            if len(x) != len(y):
                return None if (x @ x) * (y @ y) > 0 else 0.0
            return float(ratio(np.array([x @ y]), np.array([np.sqrt((x @ x) * (y @ y))]))[0])

        parts = []
        for at in range(0, len(a), rows):
            p, q = a.slice(at, rows), b.slice(at, rows)
            x, y = matrix(p), matrix(q)
            if x is None or y is None or x.shape[1] != y.shape[1]:
                parts.append(pa.array([single(*r) for r in zip(p.to_pylist(), q.to_pylist())], pa.float64()))
                continue
            dot = lambda u, v: np.einsum("ij,ij->i", u, v)
            parts.append(pa.array(ratio(dot(x, y), np.sqrt(dot(x, x) * dot(y, y)))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.float64())

    return cosines


def _scorer(k: int | None, floor: float | None, slice_rows: int = 512):
    """Best k left rows for each right row (all rows above `floor` when k is None).

    Similarities are rounded at twelve decimals and ties go to the smaller left id, so the
    outcome does not depend on how rows are batched.
    """
    def unit(column):
        import numpy as np

        flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
        m = flat.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(flat), -1)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def best(found):
        """The k best rows of each right row; `found` has right_row, similarity, left_id."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if k is None or found.num_rows == 0:
            return found
        found = found.take(pc.sort_indices(found, sort_keys=[
            ("right_row", "ascending"), ("similarity", "descending"), ("left_id", "ascending")]))
        row = found.column("right_row").to_numpy()
        start = np.r_[0, np.flatnonzero(np.diff(row)) + 1]
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
        return found.filter(pa.array(place < k))

    def score(left_cols, left_vecs, right_vecs):
        """`left_cols` are the columns to hand on, the id under the name left_id."""
        import numpy as np
        import pyarrow as pa

        left = unit(left_vecs)
        right = unit(right_vecs)
        parts = []
        for at in range(0, len(right), slice_rows):
            sims = np.round(right[at:at + slice_rows] @ left.T, 12)
            if k is not None and sims.shape[1] > k:
                edge = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
                keep = sims >= edge[:, None]
            elif floor is not None:
                keep = sims > floor
            else:
                keep = np.ones_like(sims, dtype=bool)
            r, c = np.nonzero(keep)
            parts.append(best(pa.table({
                "right_row": pa.array(r + at, pa.int64()),
                "similarity": pa.array(sims[r, c], pa.float64()),
                **{name: column.take(pa.array(c)) for name, column in left_cols.items()},
            })))
        return pa.concat_tables(parts) if parts else None

    return score, best


def _pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str, k: int | None,
           floor: float | None, ship_rows: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(left_id, right_id, similarity, *keep): partial results, k a right row from every task.

    `keep` names further left columns to carry, which saves joining them back. Null vectors,
    those of another length than most of the right side, and those with components that are
    null or not finite match nothing.
    """
    out = T.StructType([
        T.StructField(left_id, left.schema[left_id].dataType),
        T.StructField(right_id, right.schema[right_id].dataType),
        T.StructField("similarity", T.DoubleType()),
        *[T.StructField(c, left.schema[c].dataType) for c in keep],
    ])
    dim = dimension(right, vector)
    if not dim:
        return left.sparkSession.createDataFrame([], out)
    left = usable_vectors(left, dim, vector).select(left_id, vector, *keep)
    right = usable_vectors(right, dim, vector).select(right_id, vector)
    score, best = _scorer(k, floor)

    def carried(part):
        import pyarrow as pa

        flat = {c: part.column(c) for c in (left_id, *keep)}
        flat = {c: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for c, v in flat.items()}
        return {"left_id": flat.pop(left_id), **flat}

    def emit(found, right_ids):
        import pyarrow as pa

        ids = right_ids.take(found.column("right_row"))
        return pa.table({left_id: found.column("left_id"), right_id: ids, "similarity": found.column("similarity"),
                         **{c: found.column(c) for c in keep}})

    def scan_with(shipped):
        right_ids, right_vecs = shipped.column(right_id).combine_chunks(), shipped.column(vector).combine_chunks()

        def scan(batches):
            import pyarrow as pa

            held = None
            for b in batches:
                if b.num_rows == 0 or len(right_ids) == 0:
                    continue
                found = score(carried(b), b.column(vector), right_vecs)
                if k is None:
                    yield from emit(found, right_ids).to_batches()
                else:
                    held = found if held is None else best(pa.concat_tables([held, found]))
            if held is not None:
                yield from emit(held, right_ids).to_batches()

        return scan

    # The bound is checked on at most ship_rows + 1 rows.
    whole = right.limit(ship_rows + 1).toArrow()
    if whole.num_rows <= ship_rows:
        return left.mapInArrow(scan_with(whole), out)
    right = materialize(right.distinct())
    n_blocks = -(-2 * right.count() // ship_rows)
    parts, block = [], 0
    order = Window.partitionBy(right_id).orderBy(F.col("similarity").desc(), left_id)
    while block < n_blocks:
        part = right.where(F.pmod(F.xxhash64(right_id, vector), F.lit(n_blocks)) == block).limit(ship_rows + 1).toArrow()
        if part.num_rows > ship_rows:  # uneven: begin again with smaller blocks
            discard(*parts)
            parts, block, n_blocks = [], 0, 2 * n_blocks
            continue
        rows = left.mapInArrow(scan_with(part), out)
        if k is not None:
            rows = rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")
        parts.append(materialize(rows))
        block += 1
    return reduce(DataFrame.union, parts)


def rank_semantic(sims: DataFrame, top: int = K.SEMANTIC_TOP) -> DataFrame:
    """Chunk ranks from 1 by similarity, first `top` a query; similarity is then shown
    at four decimals and never below zero."""
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "chunk_id")
    return (
        sims.withColumn("sem_rank", F.row_number().over(w))
        .filter(F.col("sem_rank") <= top)
        .withColumn("similarity", F.round(F.greatest(F.lit(0.0), F.col("similarity")), 4))
    )


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = K.SEMANTIC_TOP,
                ship_rows: int = SHIP_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, chunk_id, similarity, sem_rank, *keep), the k nearest chunks of each query.

    Vectors that are null, of another length than most queries', or hold components that are null
    or not finite are left out on both sides; see rejected_vectors for their number.
    """
    pairs = _pairs(vectors, queries, "chunk_id", "query_id", "embedding", k, None, ship_rows, keep)
    return rank_semantic(pairs, k)


def similar_above(left: DataFrame, right: DataFrame, left_id: str, right_id: str, floor: float,
                  vector: str = "embedding", ship_rows: int = SHIP_ROWS) -> DataFrame:
    """(left_id, right_id, similarity) with similarity above `floor`."""
    return _pairs(left, right, left_id, right_id, vector, None, floor, ship_rows)


def encode_distinct(texts: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """Adds `embedding`; equal texts are encoded once."""
    vecs = texts.select(text).distinct().withColumn("embedding", encoder(F.col(text)))
    return texts.join(vecs, text)
