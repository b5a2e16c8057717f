"""Near-duplicate vectors by spherical-cap filters (Becker, Ducas, Gama, Laarhoven, 2016).

Filters are unit vectors with product structure: the space is turned by a random rotation
and cut into four blocks, each with its own list of random directions; a filter joins one
direction of every block. A vector is list-decoded to *all* filters whose inner product
with it reaches a threshold: partial sums of two blocks at a time are pruned against what
the other two can still add, so the product is never enumerated. Vectors that share a
filter (and label) meet, and cosines in double precision decide.

How many filters there are follows the number of vectors, so that buckets stay small, and
the threshold gives a vector about `filters_per_vector` of them; a near pair shares about
two thirds of these. A large bucket is cut into blocks of `block` vectors and every pair of
blocks is a task of its own.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.session import materialize

from .common import components, record

BLOCKS = 4


def code(dim: int, size: int, seed: int = 7) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation of `dim` (padded to a multiple of four) and four lists of `size` directions."""
    rng = np.random.default_rng(seed)
    padded = -(-dim // BLOCKS) * BLOCKS
    rotation, _ = np.linalg.qr(rng.standard_normal((padded, padded)))
    lists = []
    for _ in range(BLOCKS):
        c = rng.standard_normal((size, padded // BLOCKS))
        lists.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(BLOCKS))
    return rotation[:dim], lists


def threshold(rotation: np.ndarray, lists: list[np.ndarray], per_vector: float, seed: int = 11) -> float:
    """The inner product that a random unit vector reaches with `per_vector` filters on average."""
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((200_000, rotation.shape[1]))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    picks = [c[rng.integers(0, len(c), len(v))] for c in lists]
    dots = np.einsum("ij,ij->i", v, np.concatenate(picks, axis=1))
    total = float(np.prod([len(c) for c in lists]))
    share = min(0.5, per_vector / total)
    # The tail is beyond what a sample shows; inner products are near normal, so it is extended from the spread.
    from statistics import NormalDist

    return float(dots.std() * NormalDist().inv_cdf(1 - share))


def list_decode(v: np.ndarray, lists: list[np.ndarray], alpha: float, least: int) -> list[np.ndarray]:
    """For every (rotated, unit) vector the sorted numbers of all filters with inner product >= alpha.

    A vector with fewer than `least` of them lowers its own threshold until it has that many.
    """
    size, width = len(lists[0]), v.shape[1] // BLOCKS
    s = [v[:, i * width:(i + 1) * width] @ c.T for i, c in enumerate(lists)]
    left = (s[0][:, :, None] + s[1][:, None, :]).reshape(len(v), -1)
    right = (s[2][:, :, None] + s[3][:, None, :]).reshape(len(v), -1)
    most_l, most_r = left.max(1), right.max(1)
    out = []
    for i in range(len(v)):
        a, found = alpha, np.zeros(0, np.int64)
        while True:
            a = min(a, most_l[i] + most_r[i])
            x = np.flatnonzero(left[i] >= a - most_r[i] - 1e-12)
            y = np.flatnonzero(right[i] >= a - most_l[i] - 1e-12)
            p, q = np.nonzero(left[i][x][:, None] + right[i][y][None, :] >= a - 1e-12)
            found = np.sort(x[p].astype(np.int64) * (size * size) + y[q])
            if len(found) >= min(least, size ** BLOCKS):
                break
            a -= 0.02
        out.append(found)
    return out


_PAIRS = [("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())]
_PAIRS_DDL = "kind byte, a long, b long"


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that keep the connected parts of a symmetric boolean matrix: a breadth-first forest."""
    n, seen, edges = len(near), np.zeros(len(near), bool), []
    for s in range(n):
        if seen[s]:
            continue
        seen[s] = True
        front = [s]
        while front:
            u = front.pop()
            new = np.flatnonzero(near[u] & ~seen)
            seen[new] = True
            edges += [(u, int(w)) for w in new]
            front += new.tolist()
    return edges


def _bits(lists: list[np.ndarray], own: int) -> np.ndarray:
    """Filters below `own` of each vector, as bit rows over those that occur at all."""
    lower = [f[f < own] for f in lists]
    every, at = np.unique(np.concatenate(lower), return_inverse=True)
    rows = np.repeat(np.arange(len(lists)), [len(f) for f in lower])
    m = np.zeros((len(lists), max(1, len(every))), bool)
    m[rows, at] = True
    m = np.packbits(m, axis=1)
    return np.pad(m, ((0, 0), (0, -m.shape[1] % 8))).view(np.uint64)


def _verify(own: int, ids: np.ndarray, v: np.ndarray, lists: list[np.ndarray], weight: np.ndarray,
            part: np.ndarray, low: int, high: int, least: float):
    """Links of one bucket (or two blocks of it): spanning edges, and each vector's weighted count.

    A pair counts in the first filter that both have, and only there.
    """
    cos = v @ v.T
    near = cos >= least
    np.fill_diagonal(near, False)
    if low != high:
        near &= part[:, None] != part[None, :]
    if not near.any():
        return
    edges = _forest(near)
    bits = _bits(lists, own)
    for i in np.flatnonzero(near.any(1)):
        js = np.flatnonzero(near[i])
        js = js[~(bits[js] & bits[i]).any(1)]
        if len(js):
            yield 1, int(ids[i]), int(weight[js].sum())
    for i, j in edges:
        yield 0, int(ids[i]), int(ids[j])


def near_vectors(vectors: DataFrame, cosine: float = 0.98, filters_per_vector: float = 20.0, block: int = 1024,
                 id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """Links vectors of equal `group_col` whose cosine is at least `cosine`.

    Gives one row per input row: the id, n_links (other rows linked directly), component_id
    (smallest id reachable) and kept (id = component_id). Rows with a null group or a vector
    that is null, empty, zero or holds null or non-finite components link with nothing, and
    neither do vectors of different lengths with each other. Equal vectors are collapsed to
    their smallest id first and counted with their number, so copies cost nothing; rows that
    repeat an id count as further copies. Other columns of the input are ignored. An empty
    table gives an empty result.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).alias("grp"),
                         F.col(vector_col).cast("array<double>").alias("vec"))
    fine = (F.col("grp").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
            & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("vec", lambda x: x != 0))
    fine = F.coalesce(fine, F.lit(False))
    good = src.where(fine).select("id", "grp", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec"))  # -0.0 is 0.0
    distinct = materialize(good.groupBy("grp", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
                           .withColumn("dim", F.size("vec")))
    shapes = distinct.groupBy("dim").agg(F.count("*").alias("n"))
    shapes = shapes.orderBy(F.desc("n"), "dim").limit(64).collect()  # lengths, not rows
    if distinct.select("dim").distinct().count() > len(shapes):
        raise ValueError("vectors of more than 64 different lengths")
    spark, links = vectors.sparkSession, None
    for shape in shapes:
        found = _links(distinct.where(F.col("dim") == shape["dim"]), shape["dim"], shape["n"], cosine, filters_per_vector, block)
        links = found if links is None else links.union(found)
    if links is None:
        links = spark.createDataFrame([], _PAIRS_DDL)
    links = materialize(links)
    counts = links.where("kind = 1").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    parts = components(links.where("kind = 0")).select(F.col("node").alias("rep"), "component")
    reps = distinct.join(counts, "rep", "left").join(parts, "rep", "left").select(
        "grp", "vec", "weight", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "rep").alias("component"))
    bare = src.where(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    linked = good.join(reps, ["grp", "vec"]).select(
        "id", (F.col("weight") - 1 + F.col("others")).alias("n_links"), F.col("component").alias("component_id"))
    return linked.union(bare).select(F.col("id").alias(id_col), "n_links", "component_id",
                                     F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links(rows: DataFrame, dim: int, n: int, least: float, per_vector: float, block: int) -> DataFrame:
    size = max(4, math.ceil((n * per_vector / 64) ** (1 / BLOCKS)))  # about 64 rows a filter over all groups
    rotation, lists = code(dim, size)
    alpha = threshold(rotation, lists, per_vector)
    schema = [("rep", pa.int64()), ("filters", pa.list_(pa.int64()))]

    def decode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                v = v / np.abs(v).max(axis=1, keepdims=True)
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                yield record(schema, [part.column(0), list_decode(v @ rotation, lists, alpha, round(per_vector / 2))])

    coded = rows.select("rep", "vec").repartition("rep").mapInArrow(decode, "rep long, filters array<long>")
    coded = materialize(coded.join(rows.select("rep", "grp", "vec", "weight"), "rep"))
    keyed = coded.select("rep", "grp", F.explode("filters").alias("f"))
    sizes = keyed.groupBy("grp", "f").agg(F.count("*").alias("n")).where("n > 1")
    sizes = sizes.select("grp", "f", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    mine = keyed.join(sizes, ["grp", "f"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    mine = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    mine = mine.select("rep", "grp", "f", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    full = mine.join(coded.select("rep", "vec", "weight", "filters"), "rep").select(
        "grp", "f", "lo", "hi", "part", "rep", "weight", "filters", "vec")

    def verify(key, t):
        cols = {c: t.column(c).combine_chunks() for c in t.column_names}
        ids = cols["rep"].to_numpy()
        rank = np.argsort(ids)
        v = cols["vec"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[rank]
        v = v / np.abs(v).max(axis=1, keepdims=True)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        at, flat = cols["filters"].offsets.to_numpy(), cols["filters"].values.to_numpy()
        at = at - at[0] if len(flat) != at[-1] else at
        held = [flat[at[i]:at[i + 1]] for i in rank]
        found = list(_verify(key[1].as_py(), ids[rank], v, held, cols["weight"].to_numpy()[rank],
                             cols["part"].to_numpy()[rank], key[2].as_py(), key[3].as_py(), least))
        return pa.table({c: pa.array([x[i] for x in found], type=k) for i, (c, k) in enumerate(_PAIRS)})

    return full.groupBy("grp", "f", "lo", "hi").applyInArrow(verify, _PAIRS_DDL)
