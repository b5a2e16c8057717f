"""Set-similarity join on word n-grams by vertical partitioning (after Rong et al., FS-Join, 2017).

A document is the set of its distinct word n-grams (64-bit hashes), in the global order of the
hashes. The order is cut into fragments, every set with it. Two sets with Jaccard similarity
t or more differ in at most H = (1-t)/(1+t) (|x|+|y|) elements, so among H+1 fragments one is
the same in both: equal fragments find the candidates, and no single n-gram is ever a join
key, however frequent it is. How many fragments there are depends on the size class; a
document is also cut as its smaller partners would be. For a candidate pair, partial overlaps
are counted fragment by fragment and summed.

Groups of copies of any size stay cheap. Equal sets are one node. Every node is
first compared with one other only, the smallest of most of its buckets; what that links is
one component. Only nodes that share a fragment with a node of another component are looked at
again: among them, elements are put in order of frequency, and a pair comes up by its first
common element if what it has missed until then allows the similarity. Elements that come
too late in both of two sets are never tried, and a frequent element is cut into blocks by size
and salt. No link between different components is lost, and pairs within a component are not made.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.session import discard, materialize

from .bytetext import chunks, mix, text_column, words
from .common import components, record, trimmed

CLASS_RATIO = 1.4   # greatest over least size in a size class
BLOCK = 256         # nodes an element is joined from in one block
SALTS = 64          # blocks of one element and size class, at most


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of each row, in order; a row with fewer words has one, of all of them."""
    h, row = words(data, offsets)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.searchsorted(row, row, "left")
    last = np.searchsorted(row, row, "right")
    at = np.arange(len(h))
    whole = (last - at) >= n
    length = np.minimum(last - first, n)
    starts = np.flatnonzero(whole | ((last - first < n) & (at == first)))
    acc = np.zeros(len(starts), np.uint64)
    for k in range(n):
        inside = k < length[starts]
        nxt = h[np.minimum(starts + k, len(h) - 1)]
        acc = np.where(inside, mix(acc * np.uint64(0xD6E8FEB86659FD93) + nxt), acc)
    acc = mix(acc + length[starts].astype(np.uint64))
    rows = row[starts]
    order = np.lexsort((acc, rows))
    rows, acc = rows[order], acc[order]
    fresh = np.ones(len(acc), bool)
    fresh[1:] = (acc[1:] != acc[:-1]) | (rows[1:] != rows[:-1])
    return rows[fresh], acc[fresh]


def _classes(size: int | np.ndarray, t: float):
    """Number of the size class that holds `size` (sizes from 1)."""
    return np.floor(np.log(np.maximum(size, 1)) / np.log(CLASS_RATIO) + 1e-9).astype(np.int64)


def fragments_of_class(c: int, t: float) -> int:
    """Fragments for pairs whose smaller set is in class c: more than two sets of the pair can differ in.

    One or two further fragments allow for those that are empty in both.
    """
    small = np.ceil(CLASS_RATIO ** (c + 1) + 1e-6)
    differ = int(np.floor((1 - t) / (1 + t) * (small + small / t) + 1e-6))
    return differ + 1 + (0 if differ == 0 else 1 + differ // 40)


def fragment_keys(values: np.ndarray, c: int, t: float) -> np.ndarray:
    """A key for each fragment of one sorted set that has to be matched in class c; its low six bits are c.

    An empty fragment has a key only if there are more of them than were allowed for.
    """
    small = np.ceil(CLASS_RATIO ** (c + 1) + 1e-6)
    differ = int(np.floor((1 - t) / (1 + t) * (small + small / t) + 1e-6))
    m = fragments_of_class(c, t)
    spare = m - differ - 1
    part = (values >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)  # cuts of the global order, evenly spaced
    sums = np.zeros(m, np.uint64)
    np.add.at(sums, part.astype(np.int64), mix(values ^ np.uint64(0x5851F42D4C957F2D)))
    count = np.bincount(part.astype(np.int64), minlength=m)
    empty = count == 0
    keep = ~empty if empty.sum() <= spare else np.ones(m, bool)
    which = np.flatnonzero(keep).astype(np.uint64)
    return mix(sums[keep] + mix(which + np.uint64((c + 1) << 24))) & ~np.uint64(63) | np.uint64(c)


_SETS = [("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())]


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """Per document: the size of its set and 128 bits of its content."""
    def run(batches):
        for batch in batches:
            for i, j, data, offsets in chunks(text_column(batch)):
                rows, values = shingles(data, offsets, n)
                cuts = np.searchsorted(rows, np.arange(j - i + 1))
                size = np.diff(cuts)
                zero = np.zeros(1, np.uint64)
                total = [np.concatenate([zero, np.cumsum(mix(values ^ np.uint64(k)))]) for k in (0x1234567, 0x89ABCDEF01)]
                s1, s2 = (np.ascontiguousarray(x[cuts[1:]] - x[cuts[:-1]]).view(np.int64) for x in total)
                yield record(_SETS, [batch.column(0).slice(i, j - i), pa.array(size), pa.array(s1), pa.array(s2)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, n long, s1 long, s2 long")


HELD = 1 << 18  # fragment keys held at once by a task
_KEYS = [("node", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("a", pa.int64()), ("behind", pa.int64())]


def fragment_rows(texts: DataFrame, n: int, t: float) -> DataFrame:
    """(node, n, key, a, behind) for the fragment keys of each text (node, text).

    Keys that meet in one stretch of a task's rows are settled there: the smallest node of the
    stretch is `a` for all, and only its row, with the number `behind` it, has to be moved to
    meet the rest. So a key that a third of all documents hold is one row a stretch.
    """
    def settle(held):
        node, size, key = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((node, key))
        node, size, key = node[order], size[order], key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many = np.diff(np.r_[starts, len(key)])
        behind = np.zeros(len(key), np.int64)
        behind[starts] = many - 1
        return record(_KEYS, [node, size, key.view(np.int64), np.repeat(node[starts], many), behind])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for i, j, data, offsets in chunks(batch.column(1)):
                rows, values = shingles(data, offsets, n)
                cuts = np.searchsorted(rows, np.arange(j - i + 1))
                size = np.diff(cuts)
                own, lower = _classes(size, t), _classes(np.ceil(size * t - 1e-9), t)
                for r in np.flatnonzero(size):
                    v = values[cuts[r]:cuts[r + 1]]
                    keys = np.concatenate([fragment_keys(v, c, t) for c in range(lower[r], own[r] + 1)])
                    held.append((np.full(len(keys), nodes[i + r]), np.full(len(keys), size[r]), keys))
                    count += len(keys)
                    if count >= HELD:
                        yield settle(held)
                        held, count = [], 0
        if held:
            yield settle(held)

    return texts.select("node", "text").mapInArrow(trimmed(run), "node long, n long, key long, a long, behind long")


_GRAMS = [("node", pa.int64()), ("grams", pa.list_(pa.int64()))]


def sets_of(texts: DataFrame, n: int) -> DataFrame:
    """(node, grams) with the whole sorted set of each text."""
    def run(batches):
        for batch in batches:
            for i, j, data, offsets in chunks(text_column(batch)):
                rows, values = shingles(data, offsets, n)
                cuts = np.searchsorted(rows, np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values.view(np.int64), pa.int64()))
                yield record(_GRAMS, [batch.column(0).slice(i, j - i), lists])

    return texts.select("node", "text").mapInArrow(trimmed(run), "node long, grams array<long>")


_LINKS = [("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())]
_LINKS_DDL = "a long, b long, shared long, na long, nb long"


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int, fragments: int = 16) -> DataFrame:
    """Those of `pairs` (a, b) whose sets are similar enough, with overlap and sizes.

    b's text goes to a's: sorted by a, a stream of texts is compared with the set of the one
    that heads it. The global order is cut into `fragments`, overlaps are counted in each and
    summed. An a with many partners is dealt over several tasks.
    """
    salt = F.pmod(F.xxhash64("b"), F.lit(64))
    heavy = pairs.groupBy("a").agg(F.count("*").alias("k"))
    dealt = pairs.join(heavy, "a").withColumn("s", F.when(F.col("k") > 256, salt).otherwise(F.lit(0)))
    heads = dealt.select("a", "s").distinct().select(F.col("a").alias("node"), "a", "s", F.lit(0).alias("role"))
    rest = dealt.select(F.col("b").alias("node"), "a", "s", F.lit(1).alias("role"))
    rows = heads.union(rest).join(texts, "node").repartition("a", "s").sortWithinPartitions("a", "s", "role", "node")
    rows = rows.select("node", "a", "s", "role", "text")
    cuts = np.array([k * (1 << 64) // fragments for k in range(1, fragments)], np.uint64)

    def run(batches):
        head, key, head_cuts = None, None, None
        for batch in batches:
            node, a, s, role = (batch.column(c).to_numpy() for c in range(4))
            for i, j, data, offsets in chunks(batch.column(4)):
                rows, values = shingles(data, offsets, n)
                at = np.searchsorted(rows, np.arange(j - i + 1))
                found = []
                for r in range(j - i):
                    v = values[at[r]:at[r + 1]]
                    edges = [0, *np.searchsorted(v, cuts).tolist(), len(v)]
                    if role[i + r] == 0:
                        head, key, head_cuts = v.copy(), (a[i + r], s[i + r]), edges
                        continue
                    assert key == (a[i + r], s[i + r])
                    shared = 0
                    for k in range(fragments):
                        x, y = head[head_cuts[k]:head_cuts[k + 1]], v[edges[k]:edges[k + 1]]
                        if len(x) and len(y):
                            shared += int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                    if 100 * shared >= percent * (len(head) + len(v) - shared):
                        found.append((int(a[i + r]), int(node[i + r]), shared, len(head), len(v)))
                if found:
                    yield record(_LINKS, list(zip(*found)))

    return rows.mapInArrow(trimmed(run), _LINKS_DDL)


def _between(texts: DataFrame, where: DataFrame, n: int, t: float) -> DataFrame:
    """Candidate pairs of different components among the nodes of `where` (node, component).

    Elements go by frequency, then value. A pair comes up at an element in both prefixes, if the
    elements before it, all missing in the other set if it is the first in common, and the
    difference in number of those after it leave enough room.
    """
    grams = materialize(sets_of(texts.join(where.select("node"), "node", "left_semi"), n).select(
        "node", F.size("grams").alias("size"), F.explode("grams").alias("g")))
    often = grams.groupBy("g").agg(F.count("*").alias("df"))
    ordered = grams.join(often, "g").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("gs"))
    prefix = F.col("size") - F.ceil(F.col("size") * t - 1e-6) + 1
    posts = ordered.select("node", "size", F.posexplode(F.slice("gs", 1, prefix.cast("int"))).alias("pos", "e")).where("e.df > 1")
    posts = materialize(posts.select("node", "size", "pos", F.col("e.g").alias("g")).join(where, "node"))
    x, y = _sides(posts, t)
    x, y = x.alias("x"), y.alias("y")
    room = F.lit((1 - t) / (1 + t)) * (F.col("x.size") + F.col("y.size")) + 1e-6
    i, j = F.col("x.pos"), F.col("y.pos")
    missed = i + j + F.abs((F.col("x.size") - i) - (F.col("y.size") - j))
    met = F.lit(True)
    for c in _BY:
        met = met & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    pairs = x.join(y, met & (~F.col("y.early") | (F.col("x.node") < F.col("y.node"))) & (F.col("x.component") != F.col("y.component")) & (missed <= room))
    a, b = F.col("x.node"), F.col("y.node")
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


_BY = ["g", "block", "salt"]


def _sides(posts: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """The two sides of the join of postings (node, size, pos, g, component), with the columns _BY to join by.

    With a and b elements from positions i and j on, i + j + |a - b| is within the room of
    (1-t)/(1+t) (i + j + a + b) only if i + j <= (1-t)/t min(a, b): the smaller position is
    early in its own set, 2 i <= (1-t)/t a. So one side holds the early postings only, and
    elements that are early nowhere are gone.
    """
    early = 2 * F.col("pos") <= F.lit((1 - t) / t) * (F.col("size") - F.col("pos")) + 1e-3
    posts = posts.withColumn("early", early)
    met = posts.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count_if("early").alias("k"))
    posts = posts.join(met.where("lo <> hi AND k > 0").select("g", "k"), "g")
    hot, salts = F.col("k") > BLOCK, F.least(F.lit(SALTS), F.ceil(F.col("k") / BLOCK)).cast("int")

    def size_class(size, slack=0.0):
        return F.when(hot, F.floor(F.log(F.greatest(size, F.lit(1.0))) / float(np.log(CLASS_RATIO)) + slack).cast("int")).otherwise(0)

    size = F.col("size").cast("double")
    x = posts.where("early").withColumns({"block": size_class(size), "salt": F.pmod(F.xxhash64("node"), salts).cast("int")})
    y = posts.withColumn("block", F.explode(F.sequence(size_class(size * t, -1e-9), size_class(size / t, 1e-9))))
    return x, y.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))


def _met(keyed: DataFrame) -> DataFrame:
    """Rows (node, n, key) whose key another node has too, with the smallest node of the key."""
    first = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("key", "a")
    return keyed.select("node", "n", "key").join(first, "key").select("node", "n", "key", "a")


def first_met(keyed: DataFrame) -> DataFrame:
    """The same for fragment_rows as written: only the heads of stretches move, and once. Those behind
    a head keep it as their `a`."""
    key = Window.partitionBy("key")
    heads = keyed.where("node = a").withColumns({"lo": F.min("node").over(key), "hi": F.max("node").over(key)})
    heads = heads.where("lo <> hi OR behind > 0").select("node", "n", "key", F.col("lo").alias("a"))
    return heads.union(keyed.where("node <> a").select("node", "n", "key", "a"))


def _enough(rows: DataFrame, t: float) -> DataFrame:
    """Rows (node, n, key) of nodes with as many shared keys in a size class as any link of theirs needs.

    In class c a pair is cut into more fragments than the largest sets of the class can differ
    in; smaller sets differ in fewer, so the rest must be the same, and have keys.
    """
    share, c = (1 - t) / (1 + t), F.col("key").bitwiseAND(F.lit(63))
    small = F.ceil(F.pow(F.lit(CLASS_RATIO), c + 1) + 1e-6)
    most = F.floor(F.lit(share) * (small + small / t) + 1e-6)
    partner = F.when(F.col("n") <= small, F.col("n") / t).otherwise(small)  # the largest it can link with in this class
    own = F.floor(F.lit(share) * (F.col("n") + partner) + 1e-6)
    marked = rows.withColumns({"_c": c, "_need": F.greatest(F.lit(1).cast("long"), (most + 1 - own).cast("long"))})
    kept = marked.groupBy("node", "_c").agg(F.count("*").alias("_k"), F.max("_need").alias("_need")).where("_k >= _need").select("node", "_c")
    return marked.join(kept, ["node", "_c"], "left_semi").select(*rows.columns)


def similar_documents(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Classes of documents linked by Jaccard similarity of word n-gram sets, 100 |x & y| >= percent |x | y|.

    Takes (doc_id, text, any others) with distinct ids; gives two tables: members (doc_id,
    n_shingles, component_id: the smallest id reachable by links, itself included) and the
    links that were verified (a, b, shared, na, nb), smallest ids of equal sets standing for
    all. Words are runs of bytes other than white space, A-Z in lower case. A text with fewer
    than n words is one n-gram; a null, empty or blank one has none and links with nothing.
    Rows that repeat an id give a row each; a null id is kept and links with nothing. An empty
    table gives empty results.
    """
    t = percent / 100
    sets = materialize(signatures(docs, n))
    reps = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node"))
    reps = materialize(reps)
    own = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("node IS NOT NULL")
    heads = own.join(reps.select("node"), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    keyed = materialize(fragment_rows(heads, n, t))
    stars = materialize(first_met(keyed))
    discard(keyed)
    for _ in range(2):
        before, stars = stars, materialize(_met(_enough(stars, t)))
        discard(before)
    near = stars.where("node <> a").groupBy("node", "a").agg(F.count("*").alias("k")).groupBy(F.col("node").alias("b")).agg(
        F.max_by("a", F.struct("k", -F.col("a"))).alias("a")).select("a", "b")
    touched = stars.select("node").distinct()
    texts = materialize(own.join(touched, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")))
    links = materialize(verify(near, texts, n, percent))
    parts = materialize(components(links))
    known = materialize(stars.join(parts, "node", "left").select("node", "n", "key", F.coalesce("component", "node").alias("component")))
    mixed = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_nodes = materialize(_enough(known.join(mixed, "key"), t).select("node", "component").distinct())
    if not open_nodes.isEmpty():
        more = materialize(verify(_between(texts, open_nodes, n, t), texts, n, percent))
        if not more.isEmpty():
            links = materialize(links.union(more))
            parts = materialize(components(links))
    classes = reps.join(parts, "node", "left").select("n", "s1", "s2", F.coalesce("component", "node").alias("component"))
    ok = sets.where("n > 0 AND doc_id IS NOT NULL").join(classes, ["n", "s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    bare = sets.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return ok.union(bare), links
