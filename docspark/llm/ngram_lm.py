"""An interpolated modified Kneser-Ney bigram model, counted in Spark and scored from sorted hash arrays.

Counting. Each task counts what it has read before anything moves: first words, whose sorted
64-bit hashes become the vocabulary (a word's place is its number), then pairs of numbers.
Pairs go by their first word, or, if that is frequent, by both, so that no word is too large
for a task. Continuation counts and the numbers of followers seen once, twice and more are
sums of what the pair shards hold.

Storage. Every shard is written as plain sorted arrays in the folder that spark.checkpoint.dir
names; a repeated task replaces its files. The model knows which files there are: one that is
missing, or can't be seen yet, fails the task that asks for it. Workers map these files into memory and look up
sorted queries, so a worker holds no model of its own and its size doesn't matter.
"""
from __future__ import annotations

import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.session import materialize, shared_dir

from .bytetext import chunks, mix, text_column, words
from .common import record

SHARD_BYTES = 16 << 20      # training text a shard
SHARDS_MOST = 65_536
TOKENS = 1 << 22            # tokens a task counts together
END, BEGIN = np.uint64(0xE1D0E1D0E1D0E1D1), np.uint64(0xB1E61BB1E61BB1E7)
FREQUENT = 2048             # a first word with more than 1/FREQUENT of the tokens goes by both words

_BLOB = [("shard", pa.int32()), ("kind", pa.int8()), ("a", pa.binary()), ("b", pa.binary())]
_BLOB_DDL = "shard int, kind byte, a binary, b binary"


def _blobs(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, t) for x, (_, t) in zip(list(zip(*rows)) or [[]] * 4, _BLOB)], names=[c for c, _ in _BLOB])


def _folder(spark: SparkSession) -> str:
    """A fresh folder that the driver and all workers see under one path."""
    path = shared_dir(spark)
    if re.match(r"file:/", path):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"the model is mapped into memory: spark.checkpoint.dir must be a mounted folder, not {path}")
    os.makedirs(path, exist_ok=True)
    return path


def _save(path: str, x: np.ndarray) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        np.save(f, x)
    os.replace(own, path)


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


_maps: dict[str, np.ndarray] = {}


def _map(path: str) -> np.ndarray:
    if path not in _maps:
        if len(_maps) > 4 * 4096:
            _maps.clear()
        x = np.load(path, mmap_mode="r")
        _maps[path] = x
    return _maps[path]


def tokens(column: pa.Array, limit: int = TOKENS):
    """(first row, end row, hash, row) of some rows at a time: their words, each row closed by an end."""
    held, n, first = [], 0, 0
    for i, j, data, offsets in chunks(column):
        h, row = words(data, offsets)
        at = np.searchsorted(row, np.arange(j - i), "right")
        h = np.insert(h, at, END)
        row = np.insert(row, at, np.arange(j - i)) + i
        held.append((h, row))
        n += len(h)
        if n >= limit:
            yield first, j, np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]) - first
            held, n, first = [], 0, j
    if held:
        yield first, j, np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]) - first


def _gathered(batches):
    """Hashes of about TOKENS tokens at a time over batches, with where rows begin."""
    held, n = [], 0
    for batch in batches:
        for _, _, h, row in tokens(text_column(batch)):
            begins = np.ones(len(h), bool)
            begins[1:] = row[1:] != row[:-1]
            held.append((h, begins))
            n += len(h)
            if n >= TOKENS:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _split(kind: int, keys: np.ndarray, counts: np.ndarray, shard: np.ndarray, shards: int) -> list[tuple]:
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    out = []
    for s in np.flatnonzero(np.diff(cuts)):
        x = order[cuts[s]:cuts[s + 1]]
        out.append((int(s), kind, keys[x].tobytes(), counts[x].tobytes()))
    return out


def _merge(a: list[bytes], b: list[bytes], key_type, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts (rows of `width`)."""
    keys = np.concatenate([np.frombuffer(x, key_type) for x in a]) if a else np.zeros(0, key_type)
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in b]).reshape(-1, width) if b else np.zeros((0, width), np.uint32)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(counts, first, dtype=np.int64) if len(keys) else np.zeros((0, width), np.int64))


class Model:
    """Where the arrays lie, and the few numbers that all scores need."""

    def __init__(self, folder: str, shards: int, sizes: list[int], n_tokens: int, n_docs: int):
        self.folder, self.shards, self.n_tokens, self.n_docs = folder, shards, n_tokens, n_docs
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.n_words = max(0, int(self.base[-1]) - 1)  # BEGIN is no word
        self.frequent = np.zeros(0, np.int64)
        self.discounts, self.low_discounts = np.zeros(4), np.zeros(4)
        self.pairs, self.low_kinds = 0, np.zeros(4)
        #: which shards have a file of each name
        self.files = {"count": np.array(sizes) > 0, **{name: np.zeros(shards, bool) for name in ("follows", "kinds", "pair")}}

    def number(self, sorted_hashes: np.ndarray) -> np.ndarray:
        """Numbers of words given by distinct hashes in order; -1 for those never seen."""
        out = np.full(len(sorted_hashes), -1, np.int64)
        cuts = np.searchsorted(_shard_of(sorted_hashes, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            if self.base[s + 1] > self.base[s]:
                known, ask = _map(f"{self.folder}/word_{s}.npy"), sorted_hashes[cuts[s]:cuts[s + 1]]
                at = np.minimum(np.searchsorted(known, ask), len(known) - 1)
                out[cuts[s]:cuts[s + 1]] = np.where(known[at] == ask, at + self.base[s], -1)
        return out

    def of_number(self, name: str, numbers: np.ndarray, width: int | None = None) -> np.ndarray:
        """Values stored by word number (in order); 0 for -1."""
        out = np.zeros((len(numbers), width) if width else len(numbers), np.int64)
        cuts = np.searchsorted(numbers, self.base)
        for s in np.flatnonzero(np.diff(cuts)):
            if self.files[name][s]:
                out[cuts[s]:cuts[s + 1]] = _map(f"{self.folder}/{name}_{s}.npy")[numbers[cuts[s]:cuts[s + 1]] - self.base[s]]
        return out

    def pair_shard(self, keys: np.ndarray) -> np.ndarray:
        first = keys >> np.uint64(32)
        h = mix(first + np.uint64(77))
        if len(self.frequent):
            h = np.where(np.isin(first, self.frequent.astype(np.uint64)), mix(keys + np.uint64(99)), h)
        return _shard_of(h, self.shards)

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct pairs in order of their shard and key."""
        out = np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(self.pair_shard(keys), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            if self.files["pair"][s]:
                known, ask = _map(f"{self.folder}/pair_{s}.npy"), keys[cuts[s]:cuts[s + 1]]
                at = np.minimum(np.searchsorted(known, ask), len(known) - 1)
                out[cuts[s]:cuts[s + 1]] = np.where(known[at] == ask, _map(f"{self.folder}/pair_count_{s}.npy")[at], 0)
        return out

    def score(self, h: np.ndarray, row: np.ndarray, rows: int):
        """Per row: tokens, known tokens, the sum of log10 of the unigram base, and of the model."""
        u, inverse = np.unique(h, return_inverse=True)
        number = self.number(u)
        by = np.argsort(number, kind="stable")  # -1 first
        counts, follows = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        kinds = np.zeros((len(u), 3), np.int64)
        counts[by], follows[by], kinds[by] = self.of_number("count", number[by]), self.of_number("follows", number[by]), self.of_number("kinds", number[by], 3)
        base = np.log10((counts + 1) / (self.n_tokens + (self.n_words + 1)))
        low = self.low(follows)
        # the word before each token
        v = np.empty(len(h), np.int64)
        v[1:] = inverse[:-1]
        begins = np.ones(len(h), bool)
        begins[1:] = row[1:] != row[:-1]
        v[begins] = -1
        begin = self.number(np.array([BEGIN]))
        begin_kinds = self.of_number("kinds", begin, 3)[0]
        context = np.where(v < 0, self.n_docs, counts[v])
        context_number = np.where(v < 0, begin[0], number[v])
        context_kinds = np.where((v < 0)[:, None], begin_kinds, kinds[v])
        p = low[inverse]
        seen = (context > 0) & (context_number >= 0)
        gamma = (context_kinds @ self.discounts[1:]) / np.maximum(context, 1)
        both = np.flatnonzero(seen & (number[inverse] >= 0))
        c = np.zeros(len(h), np.int64)
        if len(both):
            keys = (context_number[both].astype(np.uint64) << np.uint64(32)) | number[inverse[both]].astype(np.uint64)
            k, at = np.unique(keys, return_inverse=True)
            order = np.argsort(self.pair_shard(k), kind="stable")
            got = np.zeros(len(k), np.int64)
            got[order] = self.pair_counts(k[order])
            c[both] = got[at]
        high = np.maximum(c - self.discounts[np.minimum(c, 3)], 0) / np.maximum(context, 1)
        p = np.where(seen, high + gamma * p, p)
        n = np.bincount(row, minlength=rows)
        return (n, np.bincount(row, counts[inverse] > 0, minlength=rows).astype(np.int64),
                np.bincount(row, base[inverse], minlength=rows), np.bincount(row, np.log10(p), minlength=rows))

    def low(self, follows: np.ndarray) -> np.ndarray:
        """The lower-order probability of words by the number of different words before them."""
        even = 1 / (self.n_words + 1)
        if not self.pairs:
            return np.full(len(follows), even)
        own = np.maximum(follows - self.low_discounts[np.minimum(follows, 3)], 0) / self.pairs
        return own + (self.low_kinds @ self.low_discounts) / self.pairs * even


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from the numbers of n-grams seen 1, 2, 3 and 4 times.

    Where a number needed is 0 the discount of Y = n1 / (n1 + 2 n2) alone is taken; all are held between 0 and the count.
    """
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d.append(min(max(k - (k + 1) * y * b / a if a else y, 0.0), float(k)))
    return np.array(d)


def train(docs: DataFrame) -> Model:
    """Learns from all rows of docs (text; null counts as empty). No rows give a model that knows nothing."""
    spark = docs.sparkSession
    rows = docs.select("text")
    facts = rows.agg(F.sum(F.octet_length("text").cast("long")), F.count("*")).first()
    shards = int(min(SHARDS_MOST, (facts[0] or 0) // SHARD_BYTES + 4))
    folder = _folder(spark)

    def count_words(batches):
        for h, _ in _gathered(batches):
            u, c = np.unique(np.append(h, BEGIN), return_counts=True)
            c[u == BEGIN] = 0
            for out in _split(0, u, c.astype(np.uint32), _shard_of(u, shards), shards):
                yield record(_BLOB, [[x] for x in out])

    def keep_words(key, t):
        keys, counts = _merge(t.column("a").to_pylist(), t.column("b").to_pylist(), np.uint64)
        s, counts = key[0].as_py(), counts[:, 0]
        _save(f"{folder}/word_{s}.npy", keys)
        _save(f"{folder}/count_{s}.npy", counts)
        return _blobs([(s, 0, np.array([len(keys), counts.sum()]).tobytes(), None)])

    found = rows.mapInArrow(count_words, _BLOB_DDL).groupBy("shard").applyInArrow(keep_words, _BLOB_DDL)
    sizes, n_tokens = [0] * shards, 0
    for r in materialize(found).select("shard", "a").collect():
        n, total = np.frombuffer(bytes(r["a"]), np.int64)
        sizes[r["shard"]], n_tokens = int(n), n_tokens + int(total)
    model = Model(folder, shards, sizes, n_tokens, facts[1])
    if model.n_words >= 1 << 32:
        raise ValueError("more than 2**32 different words")
    if not n_tokens:
        return model
    model.frequent = _frequent(spark, model)

    def count_pairs(batches):
        for h, begins in _gathered(batches):
            u, inverse = np.unique(h, return_inverse=True)
            number = model.number(u)[inverse].astype(np.uint64)
            v = np.empty(len(h), np.uint64)
            v[1:] = number[:-1]
            v[begins] = np.uint64(model.number(np.array([BEGIN]))[0])
            keys, c = np.unique((v << np.uint64(32)) | number, return_counts=True)
            for out in _split(1, keys, c.astype(np.uint32), model.pair_shard(keys), shards):
                yield record(_BLOB, [[x] for x in out])

    def keep_pairs(key, t):
        keys, counts = _merge(t.column("a").to_pylist(), t.column("b").to_pylist(), np.uint64)
        s, counts = key[0].as_py(), counts[:, 0]
        _save(f"{folder}/pair_{s}.npy", keys)
        _save(f"{folder}/pair_count_{s}.npy", counts.astype(np.uint32 if counts.max() < 1 << 32 else np.int64))
        out = []
        w, c = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        out += _split(2, w.astype(np.uint32), c.astype(np.uint32), np.searchsorted(model.base, w.astype(np.int64), "right") - 1, shards)
        v, first = np.unique(keys >> np.uint64(32), return_index=True)
        k = np.minimum(counts, 3)
        kinds = np.stack([np.add.reduceat((k == x).astype(np.uint32), first) for x in (1, 2, 3)], axis=1).astype(np.uint32)
        out += _split(3, v.astype(np.uint32), kinds, np.searchsorted(model.base, v.astype(np.int64), "right") - 1, shards)
        out.append((-1, 4, np.bincount(np.minimum(counts, 5), minlength=6).astype(np.int64).tobytes(), np.array([s]).tobytes()))
        return _blobs(out)

    def keep_kinds(key, t):
        s = key[0].as_py()
        kind, a, b = (t.column(c).to_pylist() for c in ("kind", "a", "b"))
        if s < 0:
            return _blobs([(-1, 4, sum(np.frombuffer(x, np.int64) for x in a).tobytes(), b"".join(b))])
        size = int(model.base[s + 1] - model.base[s])
        out = []
        for k, name, width in ((2, "follows", 1), (3, "kinds", 3)):
            keys, sums = _merge([x for x, y in zip(a, kind) if y == k], [x for x, y in zip(b, kind) if y == k], np.uint32, width)
            full = np.zeros((size, width), np.int64)
            full[keys.astype(np.int64) - model.base[s]] = sums
            full = full.astype(np.uint32) if not len(sums) or sums.max() < 1 << 32 else full
            _save(f"{folder}/{name}_{s}.npy", full[:, 0] if width == 1 else full)
            if k == 2:
                out.append((s, 5, np.bincount(np.minimum(full[:, 0], 5), minlength=6).astype(np.int64).tobytes(), None))
        return _blobs(out)

    found = rows.mapInArrow(count_pairs, _BLOB_DDL).groupBy("shard").applyInArrow(keep_pairs, _BLOB_DDL)
    found = found.groupBy("shard").applyInArrow(keep_kinds, _BLOB_DDL)
    high, low = np.zeros(6, np.int64), np.zeros(6, np.int64)
    for r in materialize(found).select("shard", "kind", "a", "b").collect():  # six numbers a shard, and the shards of pairs
        (high if r["kind"] == 4 else low)[:] += np.frombuffer(bytes(r["a"]), np.int64)
        if r["kind"] == 4:
            model.files["pair"][np.frombuffer(bytes(r["b"]), np.int64)] = True
        else:
            model.files["follows"][r["shard"]] = model.files["kinds"][r["shard"]] = True
    model.discounts, model.low_discounts = discounts(high[1:5].tolist()), discounts(low[1:5].tolist())
    model.pairs = int(high[1:].sum())
    model.low_kinds = np.array([0, low[1], low[2], low[3:].sum()], float)
    return model


def _frequent(spark: SparkSession, model: Model) -> np.ndarray:
    """Numbers of the words with more than 1/FREQUENT of the tokens: fewer than FREQUENT of them."""
    least = model.n_tokens / FREQUENT

    def run(batches):
        for batch in batches:
            for s in batch.column(0).to_pylist():
                if model.files["count"][s]:
                    at = np.flatnonzero(np.asarray(_map(f"{model.folder}/count_{s}.npy")) > least)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(at + model.base[s])], names=["id"])

    return np.array(sorted(r[0] for r in spark.range(model.shards).mapInArrow(run, "id long").collect()), np.int64)


_SCORES = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
           ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())]
_SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Scores every row of docs (doc_id, held_out, text), whole texts: log10 probabilities of the unigram
    base and of the model, and the model's perplexity a token. A null text is empty: its end alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few numbers a shard

    def run(batches):
        m = shared.value
        for batch in batches:
            for i, j, h, row in tokens(text_column(batch), TOKENS // 4):
                n, known, base, score = m.score(h, row, j - i)
                yield record(_SCORES, [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), n, known,
                                       np.full(j - i, m.n_tokens), base, score, 10 ** np.minimum(-score / n, 300)])

    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, _SCORES_DDL)
