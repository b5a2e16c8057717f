"""Helpers shared by the training-data operators: reading, splits, packing, components."""
from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.session import discard, materialize


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id, written as text, leaves `remainder`. A null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return (F.crc32(F.encode(text, "UTF-8")) % modulus) == remainder


def ddl(df: DataFrame, columns: list[str]) -> str:
    """The schema of some columns of `df`, as text for mapInArrow."""
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def record(schema: list[tuple[str, pa.DataType]], values: list) -> pa.RecordBatch:
    """A record batch of the given columns."""
    arrays = [v if isinstance(v, pa.Array) else pa.array(v, type=t) for (_, t), v in zip(schema, values)]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(schema))


def trimmed(run):
    """A function for mapInArrow that gives back what its worker's allocators hold unused when it ends: workers
    stay for the next task, and the memory of idle ones counts."""
    def ending(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return ending


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table: rows (node, component), where
    component is the smallest node reachable. Only nodes with an edge to another node come out.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Each step is a
    minimum per node, which combines before the shuffle, and a join of that minimum back to
    the edges; every round is a written table. Nothing reaches the driver but two sums.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = materialize(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        rest = low.where("m < u").select("u", F.col("m").alias("v"))  # a node keeps its own smallest neighbour
        large = large.union(rest).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u")
        before, now = now, materialize(linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                                       .union(small.select("u", F.col("m").alias("v"))).distinct())
        discard(before)
        n = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n[0], n[1]) == state:
            break
        state = (n[0], n[1])
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
