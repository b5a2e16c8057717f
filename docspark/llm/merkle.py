"""A Merkle manifest of a table: hash trees of fan-out 16, kept as strings of concatenated levels.

Every row is a leaf. The leaves of a tree are numbered by a range sort: each task numbers its
own rows, and the counts of the tasks before it are added, so no tree is ever in one task.
An aligned block of 256 nodes keeps each of its levels as one hex string, 64 digits a digest:
the parents are the hashes of its fixed-width substrings of 16 digests, and what flanks a
node in such a substring are its siblings, the left and the right segment of its proof. The
blocks' top digests are the nodes of the next, 256 times smaller table, and so on; the roots
of the trees are themselves the leaves of one more tree. All of it is DataFrame functions.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.session import discard, materialize

FAN = 16        # nodes a parent is made of
HEIGHT = 2      # levels that a block spans
HEX = 64        # digits a digest
BLOCK = FAN ** HEIGHT

_PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(columns: list[Column]) -> Column:
    """The digest of a row: of each value `-` if null, else its length in bytes, a colon and the value as text."""
    def part(c):
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*[part(c) for c in columns]))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the segments of its proof, level by level, lead to."""
    return F.aggregate(path, start, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def path_digest(path: Column) -> Column:
    """The digest of all siblings of a proof, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `pos` (from 0 in each `tree`, by the columns `order`) and `total`, the tree's number of rows."""
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", at)
    placed = materialize(placed.withColumn("_task", F.shiftright("_at", 33)))
    runs = placed.groupBy("tree", "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("tree").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.withColumns({
        "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "total": F.sum("_n").over(Window.partitionBy("tree"))}))
    return placed.join(runs.drop("_n"), ["tree", "_task"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop(
        "_task", "_at", "_first", "_before")


def _parents(level: Column) -> Column:
    """The next level's string: the hashes of the fixed-width substrings of this one."""
    width = FAN * HEX
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(runs, lambda r: digest(F.substring(level, r * width + 1, F.lit(width)))), "")


def _segments(levels: list[Column], used: list[Column], place: Column) -> Column:
    """The siblings of the node at `place` of a block on each level that the tree has."""
    width, steps = FAN * HEX, []
    for level, has in zip(levels, used):
        start = F.floor(place / FAN).cast("int") * width
        own = F.pmod(place, F.lit(FAN)).cast("int") * HEX
        left = F.substring(level, start + 1, own)
        right = F.substring(level, start + own + HEX + 1, F.lit(width - HEX) - own)
        steps.append(F.when(has, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array().cast(_PATH)))
        place = F.floor(place / FAN)
    return F.concat(*steps)


def _blocks(nodes: DataFrame) -> DataFrame:
    """The aligned blocks of (tree, pos, total, digest, any others): members in order, the level strings,
    the block's top digest and how many blocks the tree has."""
    member = F.struct(F.pmod("pos", F.lit(BLOCK)).cast("int").alias("place"), "digest",
                      F.struct(*[c for c in nodes.columns if c not in ("tree", "digest")]).alias("rest"))
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("tree", "block").agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(member)).alias("members"))  # at most BLOCK nodes
    blocks = blocks.withColumn("level0", F.array_join(F.transform("members", lambda m: m["digest"]), ""))
    left = F.col("total")
    for k in range(HEIGHT):
        blocks = blocks.withColumn(f"level{k + 1}", F.when(left > 1, _parents(F.col(f"level{k}"))).otherwise(F.col(f"level{k}")))
        left = F.ceil(left / FAN)
    return blocks.withColumnRenamed(f"level{HEIGHT}", "top").withColumn("blocks", left)


def build(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of all trees, as written tables: each stage has the tops of the one before as its nodes."""
    stages = []
    while True:
        stages.append(materialize(_blocks(nodes)))
        more = stages[-1].where("blocks > 1")
        if more.isEmpty():
            return stages
        nodes = more.select("tree", F.col("block").alias("pos"), F.col("blocks").alias("total"), F.col("top").alias("digest"))


def roots(stages: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree."""
    return reduce(DataFrame.union, [s.where("blocks = 1").select("tree", F.col("top").alias("root")) for s in stages])


def prove(stages: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """The nodes that `build` was given, with `path`, the segments up to the `root`.

    With `above` (tree, path, root) the trees' roots are proved further: the path goes on,
    `subroot` is the root of the tree itself and `root` that of `above`.
    """
    higher = None
    for blocks in reversed(stages):
        whole = blocks.where("blocks = 1").withColumn("subroot", F.col("top"))
        if above is None:
            whole = whole.withColumns({"up": F.array().cast(_PATH), "root": F.col("top")})
        else:
            whole = whole.join(above.select("tree", F.col("path").alias("up"), "root"), "tree")
        if higher is not None:
            whole = whole.unionByName(blocks.where("blocks > 1").join(higher, ["tree", "block"]))
        used, left = [], F.col("total")
        for _ in range(HEIGHT):
            used.append(left > 1)
            left = F.ceil(left / FAN)
        levels = [F.col(f"level{k}") for k in range(HEIGHT)]
        member = F.transform("members", lambda m: F.struct(m["digest"].alias("digest"), m["rest"].alias("rest"),
                                                           _segments(levels, used, m["place"]).alias("path")))
        rows = whole.select("tree", "subroot", "root", "up", F.explode(member).alias("m"))
        rows = rows.select("tree", "subroot", "root", "m.digest", "m.rest.*", F.concat("m.path", "up").alias("path"))
        if blocks is not stages[0]:
            higher = materialize(rows.select("tree", F.col("pos").alias("block"), F.col("path").alias("up"), "root", "subroot"))
    return rows


def manifest(rows: DataFrame, columns: list[str], tree: str, order: str, forged: dict[str, Column] | None = None,
             when: Column | None = None) -> DataFrame:
    """Leaf, proof and roots of every row.

    `columns` make the leaf; rows with the same `tree` are one tree, its leaves by `order` (nulls
    first, equal ones by leaf); the trees' roots, by name (null first, bytewise), make the root.
    Gives (order, tree, leaf, subroot, root, path, claim): `path` is the list of left and right
    segments up to the root, to be followed by `fold`; `claim` is the leaf of the row with the
    columns of `forged` exchanged where `when` holds, else the leaf.

    A null value is marked in the leaf, an empty text has length 0; a null tree is a tree of its
    own. Repeated rows are leaves of their own, with the same digest. A lone leaf is its tree's
    root, a lone tree's root the root of all, and their proofs are empty. An empty table gives no
    rows. Columns that are not named are ignored, so names can't clash.
    """
    plain = [F.col(f"`{c}`") for c in columns]
    other = [(forged or {}).get(c, F.col(f"`{c}`")) for c in columns]
    own = leaf(plain)
    name = F.coalesce(F.concat(F.lit("+"), F.col(f"`{tree}`").cast("string")), F.lit(""))
    claim = F.when(F.coalesce(when, F.lit(False)), leaf(other)) if when is not None else F.lit(None).cast("string")
    leaves = materialize(rows.select(name.alias("tree"), F.col(f"`{order}`").alias("key"), own.alias("digest"), claim.alias("claim")))
    stages = build(numbered(leaves, ["key", "digest"]))
    tops = materialize(roots(stages).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")))
    above = prove(build(numbered(tops, ["name"]))).select(F.col("name").alias("tree"), "path", "root")
    done = prove(stages, materialize(above))
    discard(leaves, tops)
    named = F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1))
    return done.select(F.col("key").alias(order), named.alias(tree), F.col("digest").alias("leaf"), "subroot", "root", "path",
                       F.coalesce("claim", "digest").alias("claim"))
