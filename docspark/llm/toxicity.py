"""Toxicity of texts by a counterfactually regularised classifier.

A sparse logistic model over the distinct words of a text, and over word beginnings of four to
eight bytes by how dense they are in it (inflected languages have no list of words). It is fitted to minimise the
log-loss on labelled texts, an L1 penalty, and a counterfactual penalty: in every labelled
sentence that names a group, the identity term is swapped for the others of its kind and for
a neutral word, and the squared change of the sentence's score is charged, over all features
that the swap changes: words and the word beginnings that grow or cease to be dense. So a model
can't lean on the mention of a group, which keeps neutral mentions from being rejected.

The sum of squared changes is a quadratic form of the weights. Its matrix has a row and a column
for each feature made of an identity term, so it is bounded by the list of terms; tasks sum
their share of it over the sentences they hold, and only these sums are moved.

Fitting takes a bounded sample of the labelled texts (`sample` rows, by a hash of the id);
the sample is small enough to be sent to the tasks that scan the texts. Candidate words come
from aggregates over it, and only their occurrences reach the driver. Scoring is one scan of
whole texts with no shuffle.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.session import materialize

from .bytetext import LOWER, chunks, prefix_sums, runs, span_hash, text_column
from .common import record

# Identity terms by kind; the first of each is the neutral word of its kind.
IDENTITY = [
    ["people", "christian", "christians", "muslim", "muslims", "jewish", "jews", "jew", "hindu", "hindus", "buddhist",
     "buddhists", "catholic", "catholics", "protestant", "atheist", "atheists", "sikh", "mormon"],
    ["person", "man", "men", "woman", "women", "male", "female", "girl", "girls", "boy", "boys", "transgender", "nonbinary"],
    ["adults", "gay", "gays", "lesbian", "lesbians", "bisexual", "heterosexual", "homosexual", "straight", "queer", "trans", "lgbt", "lgbtq"],
    ["citizens", "black", "blacks", "white", "whites", "asian", "asians", "african", "africans", "american", "americans", "european",
     "latino", "latina", "hispanic", "arab", "arabs", "chinese", "indian", "indians", "mexican", "mexicans", "immigrant",
     "immigrants", "refugee", "refugees"],
    ["patients", "deaf", "blind", "disabled", "elderly", "autistic"],
]

SAMPLE = 16_384      # labelled texts used for fitting, at most
CANDIDATES = 4_096   # features the model chooses from
MIN_TEXTS = 3        # toxic (or clean) sample texts that a candidate word occurs in
L1 = 1e-4
SWAP = 1.0           # weight of the counterfactual penalty
STEPS = 600

PREFIXES = (4, 5, 6, 7, 8)        # bytes
DENSITIES = (0.0, 0.01, 0.02, 0.04)  # shares of a text's words; a beginning counts from its second occurrence on

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """Hash, row, start and end of each run of letters, lower-cased for A-Z, and the prefix sums behind the hashes.

    The low three bits are left for the kind of a feature: 0 for a word, 1 to 4 for a density.
    """
    starts, ends = runs(_LETTER[data], offsets)
    sums = prefix_sums(LOWER[data])
    return _base(span_hash(sums, starts, ends)), np.searchsorted(offsets, starts, "right") - 1, starts, ends, sums


def _base(h: np.ndarray) -> np.ndarray:
    return h & ~np.uint64(7)


def _distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) and how often each occurs, in order."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def features(data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of a chunk; with `known` (sorted base hashes) only features of these."""
    def only(row, h):
        if known is None:
            return row, h
        if not len(known):
            return row[:0], h[:0]
        hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        return row[hit], h[hit]

    h, row, starts, ends, sums = word_hashes(data, offsets)
    n_words = np.bincount(row, minlength=len(offsets) - 1)
    r, f, _ = _distinct(*only(row, h))
    rows, found = [r], [f]
    for size in PREFIXES:
        long = ends - starts >= size
        r, f, c = _distinct(*only(row[long], _base(span_hash(sums, starts[long], starts[long] + size))))
        for level, least in enumerate(DENSITIES, 1):
            dense = (c >= 2) & (c >= least * n_words[r])
            rows.append(r[dense])
            found.append(f[dense] | np.uint64(level))
    return np.concatenate(rows), np.concatenate(found)


def term_hashes(terms: list[str]) -> np.ndarray:
    out = np.zeros(len(terms), np.uint64)
    for i, j, data, offsets in chunks(pa.array(terms, pa.string())):
        out[i:j] = word_hashes(data, offsets)[0]
    return out


def _signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def _places(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where in `known` (any order) each hash lies, -1 if nowhere."""
    order = np.argsort(known)
    at = order[np.minimum(np.searchsorted(known, h, sorter=order), len(known) - 1)]
    return np.where(known[at] == h, at, -1)


class Kind:
    """The features made of one kind of identity terms: their words, and their word beginnings a density."""

    def __init__(self, terms: list[str]):
        self.terms = term_hashes(terms)
        begins = [term_hashes([t[:size] for size in PREFIXES if len(t) >= size]) for t in terms]
        self.begins = np.unique(np.concatenate(begins))
        self.has = np.array([np.isin(self.begins, b) for b in begins])
        self.features = np.concatenate([self.terms, *[self.begins | np.uint64(k) for k in range(1, len(DENSITIES) + 1)]])

    def present(self, words: np.ndarray, begins: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which features sentences of n words have, from their counts of terms and of beginnings."""
        dense = [(begins >= 2) & (begins >= least * n[:, None]) for least in DENSITIES]
        return np.concatenate([words >= 1, *dense], axis=1).astype(np.float32)

    def products(self, hashed, unit: np.ndarray) -> np.ndarray:
        """Sum of the outer products of feature changes, over all swaps of all sentences (`unit`: a word's sentence)."""
        h, _, starts, ends, sums = hashed
        m, p = self.has.shape
        total = np.zeros((len(self.features),) * 2)
        term = _places(h, self.terms)
        mention, times = np.unique(unit[term > 0] * m + term[term > 0], return_counts=True)
        if not len(mention):
            return total
        units, at = np.unique(mention // m, return_inverse=True)  # sentences that name a group
        inside = np.flatnonzero(np.isin(unit, units))
        own, n = np.searchsorted(units, unit[inside]), np.bincount(unit)[units]
        hit = term[inside] >= 0
        words = np.bincount(own[hit] * m + term[inside][hit], minlength=len(units) * m).reshape(-1, m)
        begins = np.zeros(len(units) * p, np.int64)
        for size in PREFIXES:
            long = ends[inside] - starts[inside] >= size
            first = starts[inside][long]
            place = _places(_base(span_hash(sums, first, first + size)), self.begins)
            begins += np.bincount(own[long][place >= 0] * p + place[place >= 0], minlength=len(units) * p)
        begins = begins.reshape(-1, p)
        has = self.has.astype(np.int64)
        for i in range(0, len(mention), 2048):
            x, u, k = mention[i:i + 2048] % m, at[i:i + 2048], times[i:i + 2048, None]
            before = self.present(words[u], begins[u], n[u])
            for y in range(m):
                rows = np.flatnonzero(x != y)
                swapped = words[u[rows]]
                swapped[np.arange(len(rows)), x[rows]] = 0
                swapped[:, y] += k[rows, 0]
                after = self.present(swapped, begins[u[rows]] + k[rows] * (has[y] - has[x[rows]]), n[u[rows]])
                change = after - before[rows]
                total += change.T @ change
        return total


_SWAP = pa.struct([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _swaps(data: np.ndarray, hashed, kinds: list[Kind]) -> pa.StructArray:
    """Non-zero products of feature changes of a chunk's swaps, a row for each kind and two features."""
    _, row, starts, *_ = hashed
    parts = [np.zeros((4, 0), np.int64)]
    if len(row):
        sentence = np.cumsum(_STOP[data])[starts]
        unit = np.cumsum(np.append(0, (row[1:] != row[:-1]) | (sentence[1:] != sentence[:-1])))
        for k, kind in enumerate(kinds):
            sums = kind.products(hashed, unit)
            a, b = np.nonzero(sums)
            f = _signed(kind.features)
            parts.append(np.stack([np.full(len(a), k), f[a], f[b], sums[a, b].astype(np.int64)]))
    kind, a, b, n = np.concatenate(parts, axis=1)
    return pa.StructArray.from_arrays([pa.array(kind, pa.int32()), *map(pa.array, (a, b, n))], fields=list(_SWAP))


_WORDS = [("doc_id", pa.int64()), ("toxic", pa.int32()), ("words", pa.list_(pa.int64())), ("named", pa.list_(pa.int64())), ("swaps", pa.list_(_SWAP))]


def _sample_words(rows: DataFrame) -> DataFrame:
    """Per text: its distinct features (words), and the identity terms of its sentences (once a sentence);
    the first text of a chunk also carries what the swaps in the chunk's sentences change (swaps)."""
    identity = np.sort(term_hashes([t for kind in IDENTITY for t in kind[1:]]))

    def run(batches):
        kinds = [Kind(terms) for terms in IDENTITY]
        for batch in batches:
            for i, j, data, offsets in chunks(text_column(batch)):
                hashed = word_hashes(data, offsets)
                h, row, start, *_ = hashed
                swaps = _swaps(data, hashed, kinds)
                hit = np.isin(h, identity)
                sentence = np.cumsum(_STOP[data])[start[hit]] if hit.any() else np.zeros(0, np.int64)
                named = np.unique(np.stack([row[hit], sentence, _signed(h[hit])]), axis=1) if hit.any() else np.zeros((3, 0), np.int64)
                row, h = features(data, offsets)
                order = np.argsort(row, kind="stable")
                row, h = row[order], _signed(h[order])
                cuts = np.searchsorted(row, np.arange(j - i + 1))
                named_cuts = np.searchsorted(named[0], np.arange(j - i + 1))
                lists = [pa.ListArray.from_arrays(pa.array(c, pa.int32()), pa.array(v, pa.int64())) for c, v in ((cuts, h), (named_cuts, named[2]))]
                lists.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.full(j - i, len(swaps))), pa.int32()), swaps))
                yield record(_WORDS, [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *lists])

    return rows.mapInArrow(run, "doc_id long, toxic int, words array<long>, named array<long>, swaps array<struct<kind:int,a:long,b:long,n:long>>")


def train(x_row: np.ndarray, x_col: np.ndarray, y: np.ndarray, n_words: int, swaps: tuple[np.ndarray, np.ndarray, np.ndarray],
          l1: float = L1, swap: float = SWAP, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient steps on log-loss + l1 |w| + swap * mean squared score change of swaps.

    x: (row, feature) occurrences; swaps: (feature, feature, mean product of their changes).
    """
    n = len(y)
    a, b, product = swaps
    per_row = np.bincount(x_row, minlength=n)
    col = np.bincount(x_col, minlength=n_words)
    reach = np.bincount(x_col, per_row[x_row] + 1, minlength=n_words) / 4 / n  # bounds the loss's curvature per word
    pull = np.bincount(a, np.abs(product), minlength=n_words)  # row sums bound the penalty's curvature
    step = 1 / (reach + 2 * swap * pull + 1e-9)
    step[col == 0] = 0
    step0 = 1 / ((per_row.mean() + 1) / 4)
    w, bias = np.zeros(n_words), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    v, v0, t = w.copy(), bias, 1.0
    for _ in range(steps):
        z = v0 + np.bincount(x_row, v[x_col], minlength=n)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.bincount(x_col, g[x_row], minlength=n_words)
        grad += 2 * swap * np.bincount(a, product * v[b], minlength=n_words)
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new0 = v0 - step0 * g.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, v0 = new + (t - 1) / t_new * (new - w), new0 + (t - 1) / t_new * (new0 - bias)
        w, bias, t = new, new0, t_new
    return w, bias


def _changes(seen: DataFrame, words: np.ndarray, mentions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean products of the changes of two features (places in `words`, sorted) over all mentions, each an even mix of its swaps."""
    sums = seen.select(F.explode("swaps").alias("s")).select("s.*").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    known = sums.orderBy("kind", "a", "b").toArrow()  # features of identity terms: bounded by their list
    kind, a, b, n = (known.column(c).to_numpy() for c in ("kind", "a", "b", "n"))
    a, b = (_places(x, words) if len(words) else np.full(len(x), -1) for x in (a, b))
    keep = (a >= 0) & (b >= 0)  # others have no weight
    alternatives = np.array([len(k) - 1 for k in IDENTITY])
    return a[keep], b[keep], n[keep] / alternatives[kind[keep]] / max(mentions, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, candidates: int = CANDIDATES, swap: float = SWAP,
        min_texts: int = MIN_TEXTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes, their weights and the bias, from docs (doc_id, text) and labels (doc_id, toxic)."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the documented bound
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text")
    seen = materialize(_sample_words(rows))
    n, n_toxic = seen.agg(F.count("*"), F.sum("toxic")).first()
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0), 0.0
    n_toxic = n_toxic or 0
    if n_toxic in (0, n):
        return np.zeros(0, np.uint64), np.zeros(0), float(np.log((n_toxic + 1) / (n - n_toxic + 1)))
    by_word = seen.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    # association: the usual z-score of two shares
    rate, base = (F.col("t") + F.col("c")) / n, F.lit(n_toxic / n)
    gap = F.abs(F.col("t") / n_toxic - F.col("c") / (n - n_toxic)) / F.sqrt(rate * (1 - rate) + 1 / n) * F.sqrt(base * (1 - base) * n)
    chosen = by_word.where(F.greatest("t", "c") >= min_texts).orderBy(gap.desc(), "word").limit(candidates).select("word")
    named = seen.select(F.explode("named").alias("word")).groupBy("word").count().collect()  # at most the list of terms
    words = np.unique(np.array([r[0] for r in chosen.collect()] + [r[0] for r in named], np.int64))
    pairs = seen.select("doc_id", "toxic", F.array_intersect("words", F.lit(words.tolist()).cast("array<long>")).alias("words")).toArrow()
    cuts = pairs.column("words").combine_chunks()
    lengths = np.diff(cuts.offsets.to_numpy())
    x_row, x_col = np.repeat(np.arange(len(lengths)), lengths), np.searchsorted(words, cuts.flatten().to_numpy())
    w, bias = train(x_row, x_col, pairs.column("toxic").to_numpy().astype(float), len(words),
                    _changes(seen, words, sum(r[1] for r in named)), swap=swap)
    keep = w != 0
    hashes = words[keep].view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], w[keep][order], bias


def score_texts(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], columns: list[str]) -> DataFrame:
    """Adds `score` (0 to 1) to the `columns` of docs, from its whole `text`; a null text is scored as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most CANDIDATES words
    keep = docs.select(*columns, F.col("text").alias("_text"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*columns).dtypes)

    def run(batches):
        hashes, weights, bias = shared.value
        known = np.unique(_base(hashes))
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(batch.num_columns - 1)):
                row, h = features(data, offsets, known)
                z = np.full(j - i, bias)
                if len(h):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    hit = hashes[at] == h
                    z += np.bincount(row[hit], weights[at[hit]], minlength=j - i)
                score = pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))
                kept = batch.slice(i, j - i).columns[:-1]
                yield pa.RecordBatch.from_arrays([*kept, score], names=[*batch.schema.names[:-1], "score"])

    return keep.mapInArrow(run, f"{kinds}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, learn: DataFrame | None = None) -> DataFrame:
    """Scores every row of docs (doc_id, text, any others) with a model learned from labels (doc_id, toxic).

    `learn` (default docs) are the texts that labels may be learned from. Gives all columns of
    docs but text, plus score. Ids without a text, repeated ids, null labels and labels of
    unknown ids are harmless: a label counts for every row of its id, conflicting labels count
    as toxic. Without labels every score is 0.5; an empty table gives no rows.
    """
    model = fit(docs if learn is None else learn, labels)
    return score_texts(docs, model, [c for c in docs.columns if c != "text"])
