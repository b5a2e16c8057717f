"""Hard negatives by an inverted multi-index (Babenko, Lempitsky, 2012), exact.

Vectors are cut into two halves, each with a codebook of its own; a pair of codes is a cell.
A query's product with a row of a cell is at most the sum of two half-scores: its product
with the code's centre plus its length times the code's radius, half by half. Cells are
visited by falling sum with a heap over the two sorted lists of half-scores (the multi-
sequence walk), until no unvisited cell can change the answer.

A first sweep finds every anchor's nearest rows of its own label. They fix windows of scores; a
second sweep finds the best rows of other labels in each window and stops when every window
is certified: its k-th row so far, or its lower end, is above the next cell's bound.

The index is dealt into pages of bounded size, by neighbouring first codes. A page is the head
of a stream: it is held by one task, and the anchors that may find something in it pass by.
Vectors are moved once a sweep, anchors only to pages whose bound reaches what a sample of the
rows already gives them.
"""
from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.session import discard, materialize

from .common import record

SAMPLE = 16_384   # rows that the codebooks are fitted on and that give first thresholds, by a hash of the id
SEEDS = 4096      # of these, rows that give thresholds
CELL = 64         # rows a cell, aimed at
CODES = 256       # codes of a half, at most
ACROSS = 4        # first codes a page spans
PAGE = 16_384     # rows a page
STREAM = 65_536   # anchors that pass one copy of a page
SLACK = 1e-3      # on bounds, which are rounded; scores are whole numbers

_ROW = "page int, split int, role int, id long, label string, vec array<double>, marks array<double>"
_HITS = [("anchor_id", pa.int64()), ("mark", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
_HITS_DDL = "anchor_id long, mark long, vec_id long, score long"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def half_codebook(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of at most k clusters of the rows (Lloyd's rounds from evenly spaced distinct rows)."""
    distinct = np.unique(rows, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)] if len(distinct) else np.zeros((1, rows.shape[1]))
    for _ in range(rounds):
        code = nearest(rows, centres)
        size = np.bincount(code, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, code, rows)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray, step: int = 4096) -> np.ndarray:
    half = (centres ** 2).sum(1) / 2
    parts = [np.argmax(rows[i:i + step] @ centres.T - half, axis=1) for i in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Cells:
    """The cells of some rows, with the radius of each code over these rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, books: list[np.ndarray]):
        cut = books[0].shape[1]
        halves = [vecs[:, :cut], vecs[:, cut:]]
        codes = [nearest(h, b) for h, b in zip(halves, books)]
        order = np.lexsort((ids, codes[1], codes[0]))
        self.ids, self.labels, self.vecs = ids[order], labels[order], vecs[order]
        codes = [c[order] for c in codes]
        self.cut = cut
        self.used, self.radius, self.centres = [], [], []
        for code, half, book in zip(codes, (h[order] for h in halves), books):
            used, inside = np.unique(code, return_inverse=True)
            far = np.zeros(len(used))
            np.maximum.at(far, inside, np.sqrt(((half - book[code]) ** 2).sum(1)))
            self.used.append(used)
            self.radius.append(far)
            self.centres.append(book[used])
        key = codes[0] * len(books[1]) + codes[1]
        cells, starts = np.unique(key, return_index=True)
        ends = np.r_[starts[1:], len(key)]
        self.cells = {int(c): (int(a), int(b)) for c, a, b in zip(cells, starts, ends)}
        self.wide = len(books[1])

    def walk(self, query: np.ndarray):
        """(greatest and least possible score, first row, end row) of the cells, by falling greatest score."""
        lists = []
        for q, used, radius, centres in zip((query[:self.cut], query[self.cut:]), self.used, self.radius, self.centres):
            middle, reach = centres @ q, np.sqrt(q @ q) * radius
            order = np.argsort(-(middle + reach), kind="stable")
            lists.append(((middle + reach)[order].tolist(), (middle - reach)[order].tolist(), used[order].tolist()))
        (up1, low1, code1), (up2, low2, code2) = lists
        heap = [(-(up1[0] + up2[0]), 0, 0)] if code1 else []
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(code2):
                heapq.heappush(heap, (-(up1[i] + up2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(code1):
                heapq.heappush(heap, (-(up1[i + 1] + up2[0]), i + 1, 0))
            at = self.cells.get(code1[i] * self.wide + code2[j])
            if at is not None:
                yield SLACK - bound, low1[i] + low2[j] - SLACK, *at

    def scored(self, query: np.ndarray, spans: list) -> tuple[np.ndarray, np.ndarray]:
        rows = np.concatenate([np.arange(a, b) for a, b in spans])
        return rows, np.rint(self.vecs[rows] @ query)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def best_rows(cells: Cells, query: np.ndarray, own: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The k rows with the greatest product, `own` left out; those below `least` may be missing."""
    ids, scores, spans, held, batch = np.zeros(0, np.int64), np.zeros(0), [], 0, 64
    walk = cells.walk(query)
    while True:
        cell = next(walk, None)
        stop = cell is None or cell[0] < least
        if not stop:
            spans.append(cell[2:])
            held += cell[3] - cell[2]
        if spans and (stop or held >= batch):
            rows, got = cells.scored(query, spans)
            keep = (got >= least) & (cells.ids[rows] != own)
            ids, scores = np.concatenate([ids, cells.ids[rows[keep]]]), np.concatenate([scores, got[keep]])
            best = _best(ids, scores, k)
            ids, scores = ids[best], scores[best]
            if len(scores) == k:
                least = max(least, scores[-1])
            spans, held, batch = [], 0, batch * 2
        if stop:
            return ids, scores


def best_in_windows(cells: Cells, query: np.ndarray, label: str, windows: list[tuple[float, float, float]], k: int):
    """For each window (mark, low, high) the k best rows of other labels with a score in it: (mark, ids, scores)."""
    none = (np.zeros(0, np.int64), np.zeros(0))
    found, least = [none] * len(windows), [w[1] for w in windows]
    top, spans, held, batch = max(w[2] for w in windows), [], 0, 64
    walk = cells.walk(query)
    while True:
        cell = next(walk, None)
        stop = cell is None or cell[0] < min(least)  # every window is certified
        if not stop and cell[1] <= top:              # else all of its rows are above the windows
            spans.append(cell[2:])
            held += cell[3] - cell[2]
        if spans and (stop or held >= batch):
            rows, got = cells.scored(query, spans)
            keep = (got >= min(least)) & (got <= top) & (cells.labels[rows] != label)
            new_ids, new_scores = cells.ids[rows[keep]], got[keep]
            for i, (_, _, high) in enumerate(windows):
                inside = (new_scores >= least[i]) & (new_scores <= high)
                if inside.any():
                    ids, scores = np.concatenate([found[i][0], new_ids[inside]]), np.concatenate([found[i][1], new_scores[inside]])
                    best = _best(ids, scores, k)
                    found[i] = ids[best], scores[best]
                    if len(best) == k:
                        least[i] = max(least[i], found[i][1][-1])
            spans, held, batch = [], 0, batch * 2
        if stop:
            return [(w[0], *f) for w, f in zip(windows, found)]


def _sweep(index: DataFrame, routed: DataFrame, books: list[np.ndarray], dim: int, splits: int, answer) -> DataFrame:
    """Streams the routed anchors past their pages. `answer(cells_of, id, label, query, marks)` yields hits."""
    none = F.lit(None).cast("array<double>")
    heads = index.select("page", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), F.lit(0).alias("role"), "id", "label", "vec", none.alias("marks"))
    asked = routed.select("page", F.pmod(F.xxhash64("id"), F.lit(splits)).cast("int").alias("split"), F.lit(1).alias("role"), "id", "label", "vec", "marks")
    rows = heads.union(asked).repartition("page", "split").sortWithinPartitions("page", "split", "role", "id")

    def run(batches):
        key, held, made = None, [], {}

        def cells_of(label=None):
            if label not in made:
                ids, labels, vecs = (np.concatenate(x) for x in zip(*held))
                mine = slice(None) if label is None else labels == label
                made[label] = Cells(ids[mine], labels[mine], vecs[mine], books)
            return made[label]

        for batch in batches:
            page, split, role, ids = (batch.column(c).to_numpy() for c in range(4))
            labels = np.array(batch.column(4).to_pylist(), object)
            vecs, marks = _matrix(batch.column(5), dim), batch.column(6)
            cuts = np.flatnonzero((page[1:] != page[:-1]) | (split[1:] != split[:-1]) | (role[1:] != role[:-1])) + 1
            hits: list = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if a == b:
                    continue
                if role[a] == 0:
                    if key != (page[a], split[a]):
                        key, held, made = (page[a], split[a]), [], {}
                    held.append((ids[a:b], labels[a:b], vecs[a:b]))
                elif key == (page[a], split[a]):
                    for r in range(a, b):
                        hits += answer(cells_of, int(ids[r]), labels[r], vecs[r], marks[r].as_py())
            if hits:
                yield record(_HITS, list(zip(*hits)))

    return rows.mapInArrow(run, _HITS_DDL)


def _routed(anchors: DataFrame, dim: int, marks_of, pages: list[tuple[int, np.ndarray]], books, radius) -> DataFrame:
    """(id, label, vec, marks, page): anchors with their marks, once for each page that may hold something for them.

    `marks_of(queries, batch)` gives each anchor's marks and the score below which nothing counts.
    """
    cut = books[0].shape[1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            queries = _matrix(batch.column(2), dim)
            marks, least = marks_of(queries, batch)
            bounds = [q @ b.T + np.sqrt((q * q).sum(1))[:, None] * r for q, b, r in zip((queries[:, :cut], queries[:, cut:]), books, radius)]
            second = bounds[1].max(1)
            rows, numbers = [], []
            for number, firsts in pages:
                reach = np.flatnonzero(bounds[0][:, firsts].max(1) + second + SLACK >= least)
                rows.append(reach)
                numbers.append(np.full(len(reach), number))
            rows, numbers = np.concatenate(rows), np.concatenate(numbers)
            if len(rows):
                kept = [batch.column(c).take(pa.array(rows)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([marks[r] for r in rows], pa.list_(pa.float64())), pa.array(numbers, pa.int32())],
                                                 names=["id", "label", "vec", "marks", "page"])

    return anchors.mapInArrow(run, "id long, label string, vec array<double>, marks array<double>, page int")


def _kth(scores: np.ndarray, k: int, otherwise: float) -> float:
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else otherwise


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vec") -> DataFrame:
    """For each anchor and each of its positives the hardest negatives of a bounded hardness.

    Both tables hold an id, a label and a vector of whole numbers of one length (products are
    summed in doubles, so they must stay below 2**53). The positives of an anchor are its first
    `positives` other rows of its label by product, ties to the smaller id. Of the rows of other
    labels whose product lies between `low` and `high` per cent of the positive's, ends included,
    the first `negatives` come out: anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score. A positive with a negative product has no such row.

    Null ids, labels or vectors, and vectors that are empty or hold null take no part; rows that
    repeat an id count once, with their greatest vector; another length is an error. Other
    columns are ignored; an empty table on either side gives an empty result.
    """
    def clean(df):
        rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"),
                         F.col(f"`{vector_col}`").cast("array<double>").alias("vec"))
        rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull()))
        return rows.groupBy("id").agg(F.max(F.struct("vec", "label")).alias("r")).select("id", "r.label", "r.vec")

    spark = vectors.sparkSession
    asked = materialize(clean(anchors))
    # Of equal vectors of one label only the first few ids can ever come out.
    equal = Window.partitionBy("label", "vec").orderBy("id")
    rows = materialize(clean(vectors).withColumn("_n", F.row_number().over(equal)).where(F.col("_n") <= max(positives + 1, negatives)).drop("_n"))
    sizes = rows.select(F.size("vec").alias("n")).union(asked.select(F.size("vec"))).agg(F.min("n"), F.max("n")).first()
    n, n_asked = rows.count(), asked.count()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not n_asked:
        return spark.createDataFrame([], out)
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} components")
    dim = sizes[0]
    cut = max(1, dim // 2)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    some = _matrix(sample.column("vec"), dim)
    codes = int(min(CODES, max(1, round((n / CELL) ** 0.5))))
    books = [half_codebook(some[:, :cut], codes), half_codebook(some[:, cut:], codes)]
    seed_ids, seed_labels, seeds = sample.column("id").to_numpy()[:SEEDS], np.array(sample.column("label").to_pylist()[:SEEDS], object), some[:SEEDS]

    def assign(batches):
        for batch in batches:
            vecs = _matrix(batch.column(2), dim)
            arrays = []
            for half, book in zip((vecs[:, :cut], vecs[:, cut:]), books):
                code = nearest(half, book)
                arrays += [pa.array(code, pa.int32()), pa.array(np.sqrt(((half - book[code]) ** 2).sum(1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "c1", "d1", "c2", "d2"])

    coded = materialize(rows.select("id", "label", "vec").mapInArrow(assign, "id long, label string, vec array<double>, c1 int, d1 double, c2 int, d2 double"))
    radius = [np.zeros(len(b)) for b in books]
    for k in (1, 2):  # a row a code
        for code, far in coded.groupBy(f"c{k}").agg(F.max(f"d{k}")).collect():
            radius[k - 1][code] = far
    band = F.floor(F.col("c1") / ACROSS).cast("int")
    counts = {r[0]: r[1] for r in coded.groupBy(band.alias("band")).agg(F.count("*")).collect()}
    pages, parts, start = [], [], {}
    for b in sorted(counts):
        k = -(-counts[b] // PAGE)
        start[b] = len(pages)
        firsts = np.arange(b * ACROSS, min(len(books[0]), (b + 1) * ACROSS))
        pages += [(len(pages) + i, firsts) for i in range(k)]
        parts.append((b, start[b], k))
    lookup = F.element_at(F.create_map(*[F.lit(x) for b, s, k in parts for x in (b, s)]), band)
    many = F.element_at(F.create_map(*[F.lit(x) for b, s, k in parts for x in (b, k)]), band)
    index = materialize(coded.select((lookup + F.pmod(F.xxhash64("id"), many)).cast("int").alias("page"), "id", "label", "vec"))
    discard(coded)
    splits = -(-n_asked // STREAM)

    def first_marks(queries, batch):
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        scores = np.rint(queries @ seeds.T)
        least = np.array([_kth(s[(seed_labels == g) & (seed_ids != i)], positives, -np.inf) for i, g, s in zip(ids, labels, scores)])
        return [[x] for x in least], least

    def near(cells_of, own, label, query, marks):
        cells = cells_of(label)
        if len(cells.ids):
            ids, scores = best_rows(cells, query, own, positives, marks[0])
            yield from ((own, 0, int(i), int(s)) for i, s in zip(ids, scores))

    found = _sweep(index, _routed(asked.select("id", "label", "vec"), dim, first_marks, pages, books, radius), books, dim, splits, near)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near_rows = materialize(found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    goals = near_rows.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_set("positive_score")).alias("goals"))
    aimed = asked.join(goals, "id").select("id", "label", "vec", F.col("goals").cast("array<double>"))

    def second_marks(queries, batch):
        labels = batch.column(1).to_pylist()
        scores = np.rint(queries @ seeds.T)
        marks, least = [], []
        for goals, g, s in zip(batch.column(3).to_pylist(), labels, scores):
            other, row = s[seed_labels != g], []
            for x in goals:
                bottom, top = -((-low * int(x)) // 100), (high * int(x)) // 100
                if bottom <= top:
                    row += [x, max(float(bottom), _kth(other[(other >= bottom) & (other <= top)], negatives, -np.inf)), float(top)]
            marks.append(row)
            least.append(min(row[1::3], default=np.inf))
        return marks, np.array(least)

    def windowed(cells_of, own, label, query, marks):
        windows = [tuple(marks[i:i + 3]) for i in range(0, len(marks), 3)]
        for mark, ids, scores in best_in_windows(cells_of(), query, label, windows, negatives):
            yield from ((own, int(mark), int(i), int(s)) for i, s in zip(ids, scores))

    hits = _sweep(index, _routed(aimed, dim, second_marks, pages, books, radius), books, dim, splits, windowed)
    order = Window.partitionBy("anchor_id", "mark").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", F.col("mark").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near_rows.join(best, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
