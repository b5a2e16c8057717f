"""Language identification by error-correcting output codes over byte n-grams.

Every learned language gets a codeword of `BITS` bits, chosen greedily far apart. Bit b has a
binary classifier of its own: naive Bayes over hashed byte n-grams (1 to 4 bytes of the
lower-cased letters of a text, words set off by a blank) between the languages whose bit is 1
and those whose bit is 0. A text's outputs are mean log-odds a gram. Decoding takes the
codeword with the least loss, exp(-m) of each bit's margin m, where a bit weighs as much as
it got right on the documents it was learned from; a text whose two best codewords are nearly
as good is flagged.

Gram counts per language are one aggregation of a bounded size (TABLE x languages), counted
in each task over all of its rows before anything moves.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import chunks, text_column
from .common import record

TABLE = 1 << 15      # slots for hashed grams, each order has its own share
ORDERS = (1, 2, 3, 4)
BITS = 24
SHARPNESS = 4.0      # a mean log-odds of 1/4 is a full margin
PIECE = 1 << 20      # bytes of text at a time
LANGUAGES = 4096     # more distinct lang values than this are refused

_FOLD = np.full(256, 32, np.uint8)  # all but letters is a blank
for _b in range(256):
    if _b >= 128 or chr(_b).isalpha():
        _FOLD[_b] = ord(chr(_b).lower()) if _b < 128 else _b
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint64).astype(np.uint32)


def grams(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the slot of the gram that begins at each byte, and which of them count:
    grams don't cross rows and don't begin with two blanks."""
    folded = _FOLD[data]
    n = len(folded)
    rest = np.empty(n, np.int64)  # bytes up to the row's end
    ends = np.repeat(offsets[1:], np.diff(offsets))
    rest = ends - np.arange(n)
    blank = folded == 32
    out, acc = [], np.zeros(n, np.uint32)
    share = TABLE // len(ORDERS)
    for k, order in enumerate(ORDERS):
        shifted = np.zeros(n, np.uint32)
        shifted[:n - order + 1] = folded[order - 1:] if n >= order else 0
        acc = acc * np.uint32(257) + shifted
        slot = ((acc * _MULT[k]) >> np.uint32(32 - int(math.log2(share)))).astype(np.int32) + k * share
        good = rest >= order
        if order == 1:
            good &= ~blank
        else:
            good[:-1] &= ~(blank[:-1] & blank[1:])
        out.append((slot, good))
    return out


def codewords(n: int, bits: int = BITS, seed: int = 3) -> np.ndarray:
    """n different rows of +1/-1, each in turn the farthest of many random ones from those before;
    every bit tells some languages apart as long as there are two."""
    rng = np.random.default_rng(seed)
    rows = np.ones((1, bits))
    pool = rng.choice([-1.0, 1.0], (max(4096, 4 * n), bits))
    closest = pool @ rows[0]
    worst = np.abs(closest) if n <= 2 else closest
    for _ in range(1, n):
        pick = pool[int(np.argmin(worst))] if n > 2 else -rows[0]
        rows = np.vstack([rows, pick])
        worst = np.maximum(worst, pool @ pick)
    for b in np.flatnonzero(np.abs(rows.sum(0)) == n) if n > 1 else []:
        rows[b % n, b] *= -1
    return rows


_STATS = [("lang", pa.string()), ("counts", pa.binary())]


def _count(rows: DataFrame) -> list:
    """Gram counts per language, summed in each task and then over tasks."""
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = text_column(batch, "lang").to_pylist()
            names, of = np.unique(np.array(langs, object).astype(str), return_inverse=True) if langs else ([], [])
            for i, j, data, offsets in chunks(text_column(batch), PIECE):
                row_lang = np.repeat(of[i:j], np.diff(offsets))
                for slot, good in grams(data, offsets):
                    for k in np.unique(of[i:j]):
                        c = np.bincount(slot[good & (row_lang == k)], minlength=TABLE)
                        sums[str(names[k])] = sums[str(names[k])] + c if str(names[k]) in sums else c
        for name, x in sums.items():
            yield record(_STATS, [[name], [x.astype(np.int64).tobytes()]])

    def merge(key, t):
        total = np.zeros(TABLE, np.int64)
        for c in t.column("counts").to_pylist():
            total += np.frombuffer(c, np.int64)
        return pa.table({"lang": [key[0].as_py()], "counts": [total.tobytes()]}, schema=pa.schema(_STATS))

    spread = rows.select("lang", "text").mapInArrow(run, "lang string, counts binary")
    # sums of sums: tasks are dealt to a few groups a language first, so that no group grows with the tasks
    some = spread.withColumn("g", F.pmod(F.xxhash64("counts"), F.lit(32)))
    some = some.groupBy("lang", "g").applyInArrow(lambda key, t: merge(key, t), "lang string, counts binary")
    found = some.groupBy("lang").applyInArrow(merge, "lang string, counts binary").limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return sorted(found, key=lambda r: r["lang"])


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, codewords, gram weights (TABLE x BITS, float32) and bit weights, from rows with lang and text.

    A bit weighs as much as the margin that its classifier has on the grams it was learned from."""
    found = _count(rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    langs = [r["lang"] for r in found]
    if not langs:
        return [], np.zeros((0, BITS)), np.zeros((TABLE, BITS), np.float32), np.ones(BITS)
    c = np.stack([np.frombuffer(r["counts"], np.int64) for r in found]).astype(float)
    code = codewords(len(langs))
    weights = np.zeros((TABLE, BITS), np.float32)
    share = TABLE // len(ORDERS)
    p = np.zeros_like(c)  # each language weighs the same, each order of grams is a distribution of its own
    for k in range(len(ORDERS)):
        part = slice(k * share, (k + 1) * share)
        p[:, part] = (c[:, part] + 0.5) / (c[:, part].sum(1, keepdims=True) + 0.5 * share)
    for b in range(BITS):
        one, zero = code[:, b] > 0, code[:, b] < 0
        if one.any() and zero.any():
            weights[:, b] = np.log(p[one].mean(0)) - np.log(p[zero].mean(0))
    margins = np.clip(SHARPNESS * (c / np.maximum(c.sum(1, keepdims=True), 1)) @ weights * code, -3, 3)
    return langs, code, weights, np.maximum(margins.mean(0), 0.05)


def outputs(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, some: int = 32) -> np.ndarray:
    """Mean log-odds a gram of every bit, for each row of a chunk: counts of `some` rows at a time, times the weights."""
    n = len(offsets) - 1
    found = grams(data, offsets)
    out = np.zeros((n, weights.shape[1]))
    for i in range(0, n, some):
        j = min(n, i + some)
        a, b = offsets[i], offsets[j]
        shift = np.repeat(np.arange(j - i, dtype=np.int32) * TABLE, np.diff(offsets[i:j + 1]))
        c = np.zeros((j - i) * TABLE, np.int64)
        for slot, good in found:
            c += np.bincount((slot[a:b] + shift)[good[a:b]], minlength=len(c))
        c = c.reshape(j - i, TABLE).astype(np.float32)
        out[i:j] = (c @ weights) / np.maximum(c.sum(1, keepdims=True), 1)
    return out


def decode(f: np.ndarray, code: np.ndarray, bit_weight: np.ndarray) -> np.ndarray:
    """Posterior-like shares of the languages: softmax of minus the weighted loss of their codewords."""
    margin = np.clip(SHARPNESS * f, -3, 3)
    good, bad = np.exp(-margin), np.exp(margin)  # loss if the codeword's bit is +1, if it is -1
    loss = (good * bit_weight) @ (code > 0).T + (bad * bit_weight) @ (code < 0).T
    loss /= bit_weight.sum() / 8  # in eighths of the bits
    e = np.exp(loss.min(1, keepdims=True) - loss)
    return e / e.sum(1, keepdims=True)


_OUT = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())]


def identify(docs: DataFrame, learn_from: DataFrame, margin: float = 0.2) -> DataFrame:
    """Predicts the language of every row of `docs` (doc_id, held_out, text) from `learn_from` (lang, text).

    Gives doc_id, held_out, lang_pred, score (the share of the best codeword, 0 to 1) and
    ambiguous (the best two shares differ by less than `margin`). A text that is null or has no
    letter is `und` with score 0 and not ambiguous, and so is every text if nothing can be
    learned; with one language learned all others are that one. Rows to learn from with a null
    text or lang are left out; an empty lang is a value; ties go to the first lang in order.
    The learned table has a fixed size, so sending it to the tasks is bounded.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(learn_from))

    def run(batches):
        langs, code, weights, bit_weight = model.value
        names = np.array([*langs, "und"], object)
        for batch in batches:
            text = text_column(batch)
            lettered = text_column(batch, "lettered").to_numpy(zero_copy_only=False)
            for i, j, data, offsets in chunks(text, PIECE):
                ok = lettered[i:j].astype(bool) & bool(langs)
                f = outputs(data, offsets, weights)
                if langs:
                    p = decode(f, code, bit_weight)
                    best = p.argmax(1)
                    top = p[np.arange(len(p)), best]
                    p[np.arange(len(p)), best] = -1
                    second = np.maximum(p.max(1), 0)
                else:
                    best, top, second = np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i)
                best = np.where(ok, best, len(langs))
                yield record(_OUT, [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(names[best].tolist(), pa.string()),
                                    pa.array(np.where(ok, top, 0.0)), pa.array(ok & (top - second < margin))])

    rows = docs.select(F.col("doc_id").cast("long"), "held_out", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
