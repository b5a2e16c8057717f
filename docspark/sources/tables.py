"""Corpus tables as Parquet: the catalog and the search index."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.tags import decode_json
from ..functions.text import empty_entities
from ..operators.lexical import length_parts, term_headers
from .snapshots import Snapshots

EMPTY = {
    "tags": lambda: F.array().cast("array<string>"),
    "classifications": lambda: F.create_map().cast("map<string,array<string>>"),
    "key_findings": lambda: F.array().cast("array<string>"),
    "entities": empty_entities,
}


def decode_catalog(rows: DataFrame) -> DataFrame:
    """JSON text columns become nested columns; nested ones only lose their nulls."""
    out = {}
    for name, ddl in S.JSON_COLUMNS.items():
        if name not in rows.columns:
            continue
        if isinstance(rows.schema[name].dataType, T.StringType):
            out[name] = decode_json(name, ddl, EMPTY[name]())
        else:
            out[name] = F.coalesce(F.col(name), EMPTY[name]())
    return rows.withColumns(out)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return decode_catalog(spark.read.parquet(path))


def write_catalog(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    docs.write.mode(mode).parquet(path)


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.drop("bucket").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))


INDEX = ("chunks", "vectors", "postings")
#: Parts of A7 that follow from postings with lengths, kept by bucket like the tables they come from.
STATS = ("headers", "parts")


def write_index(chunks: DataFrame, vectors: DataFrame, postings: DataFrame, path: str,
                buckets: int = 64, files: int | None = None) -> None:
    """The three index tables, partitioned by a hash bucket of the document, as a new version of `path`.

    Hash buckets stay level whatever the document ids look like, and an upsert only has
    to rewrite the buckets it touches. A bucket becomes as many files as its size asks for
    (spark.sql.adaptive.advisoryPartitionSizeInBytes), so no task takes a whole large bucket;
    with `files` rows are dealt by bucket and a salt of the document instead, and a bucket is
    that many files. Postings are sorted by term in their files; if they carry lengths
    (build_postings), the term statistics of each bucket are written beside them.
    """
    shots = Snapshots(postings.sparkSession, path)
    given = {"chunks": chunks, "vectors": vectors, "postings": postings}
    _commit(shots, {n: _bucketed(df, buckets) for n, df in given.items()}, None, buckets, files)


def _write_buckets(rows: DataFrame, folder: str, buckets: int, files: int | None) -> None:
    if files is None:
        dealt = rows.hint("rebalance", "bucket")
    else:
        salt = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(files)) if "doc_id" in rows.columns else F.lit(0)
        dealt = rows.repartition(buckets * files, "bucket", salt)
    order = ["bucket", *[c for c in ("term",) if c in rows.columns]]
    dealt.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(folder)


def _commit(shots: Snapshots, tables: dict[str, DataFrame], touched: set[int] | None, buckets: int, files: int | None) -> None:
    """Writes the rows of the touched buckets (None: all) to new folders and switches to them at once."""
    now = shots.read()
    turn = now.get("turn", -1) + 1
    named = dict(now["tables"])

    def put(name, rows):
        folder = f"{name}/index_version={turn}"
        _write_buckets(rows, f"{shots.root}/{folder}", buckets if touched is None else max(1, len(touched)), files)
        kept = [] if touched is None else [f for f in named.get(name, []) if int(f.rsplit("=", 1)[1]) not in touched]
        named[name] = kept + [f"{folder}/{b}" for b in shots.children(folder) if b.startswith("bucket=")]

    for name, rows in tables.items():
        put(name, rows)
    if "postings" in tables and {"term", "tf", "dl"} <= set(tables["postings"].columns):
        fresh = [f for f in named["postings"] if f.startswith(f"postings/index_version={turn}/")]
        if fresh or touched is None:
            written = shots.table("postings", {"tables": {"postings": fresh}}, tables["postings"].schema)
            put("headers", term_headers(written))
            put("parts", length_parts(written.select("bucket", "doc_id", "dl").distinct()))
        else:
            for name in STATS:
                named[name] = [f for f in named.get(name, []) if int(f.rsplit("=", 1)[1]) not in touched]
    shots.commit({"tables": named, "turn": turn, "buckets": buckets})
    shots.vacuum()


def update_index(spark: SparkSession, path: str, gone: DataFrame, new: dict[str, DataFrame],
                 buckets: int = 64, files: int | None = None) -> None:
    """U1 and U2 on a written index: the documents of `gone` (doc_id) leave it and the rows of
    `new` (by table name) come in. Give documents that change on both sides.

    Only the buckets of these documents are read, and written again in new folders; one
    rename of the manifest makes all tables new at once. A reader that began before keeps
    reading the version before. `buckets` is that of write_index.
    """
    shots = Snapshots(spark, path)
    now = shots.read()
    if now.get("buckets") != buckets:
        raise ValueError(f"the index has {now.get('buckets')} buckets, not {buckets}")
    ids = gone.select("doc_id").distinct()
    fresh = {n: _bucketed(df, buckets) for n, df in new.items()}
    changed = _bucketed(ids, buckets).select("bucket")
    for df in fresh.values():
        changed = changed.union(df.select("bucket"))
    touched = {r[0] for r in changed.distinct().collect()}  # bucket numbers
    if not touched:
        return
    tables = {}
    for name in INDEX:
        folders = [f for f in now["tables"].get(name, []) if int(f.rsplit("=", 1)[1]) in touched]
        if folders:
            left = shots.table(name, {"tables": {name: folders}}).drop("index_version").join(ids, "doc_id", "left_anti")
            tables[name] = left.unionByName(fresh[name]) if name in fresh else left
        elif name in fresh:
            tables[name] = fresh[name]
    _commit(shots, tables, touched, buckets, files)


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the newest version: chunks, vectors and postings (with their bucket), and, if the
    postings carry lengths, headers and parts for the search."""
    shots = Snapshots(spark, path)
    now = shots.read()
    return {n: shots.table(n, now).drop("index_version", *([] if n in ("postings", *STATS) else ["bucket"])) for n in (*INDEX, *STATS) if now["tables"].get(n)}
