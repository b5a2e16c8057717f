"""Typed hooks for models and libraries, each with a default that needs no model.

A hook is a callable from Columns to a Column. Wrap a model in an iterator
`pandas_udf`, so that a worker loads it once; the defaults stay in the JVM where
built-in functions can express them. Functions sent to workers are nested here, so
that a worker needs nothing but pandas and Arrow.
"""
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codepoints import DIGIT, LETTER, text_tools
from .text import col, let, model_summary_input, model_summary_output, fallback_summary, words

Encoder = Callable[[Column], Column]
DIMENSIONS = 64


def hash_encoder(text) -> Column:
    """M1: signed hashing of word tokens into 64 buckets, scaled to unit length.

    The first byte of a token's md5, modulo 128, gives its code: bucket and sign. Lower case is the
    JVM's; a batch's texts are cut at the JVM's kinds of characters (codepoints), its distinct words
    are hashed once in Python, and the batch is summed at once.
    """
    return _hashed_sums()(F.make_valid_utf8(F.lower(col(text))))


def _hashed_sums(rows: int = 1024, piece: int = 1 << 21) -> Encoder:
    size = DIMENSIONS
    kind_of, runs, coded, pieces = text_tools(SparkSession.active())
    in_word = LETTER | DIGIT
    memo: dict[bytes, int] = {}  # codes of recent words

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def sums(s: pa.Array) -> pa.Array:
        from hashlib import md5

        import numpy as np
        import pyarrow as pa

        def words_of(data, offsets):
            """Row and code of every word."""
            inside = kind_of(data) & in_word > 0
            first, last = runs(inside, offsets)
            number, known = coded(data, inside, first, last)
            if len(memo) > 1 << 18:
                memo.clear()
            codes = []
            for w in known.cast(pa.binary()).to_pylist():
                code = memo.get(w)
                if code is None:
                    code = memo[w] = md5(w).digest()[0] % (2 * size)
                codes.append(code)
            return np.searchsorted(offsets, first, "right") - 1, np.array(codes, np.int64)[number]

        out = np.zeros((len(s), size))
        for i, j, data, offsets in pieces(s, piece):  # what is needed beside the vectors is bounded by a piece or one text
            if not len(data):
                continue
            row, code = words_of(data, offsets)
            for at in range(0, j - i, rows):
                n = min(rows, j - i - at)
                lo, hi = np.searchsorted(row, (at, at + n))
                counts = np.bincount((row[lo:hi] - at) * 2 * size + code[lo:hi], minlength=n * 2 * size).reshape(n, 2, size)
                v = (counts[:, 0] - counts[:, 1]).astype("float64")
                norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
                out[i + at:i + at + n] = np.divide(v, norm, out=v, where=norm > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * size, pa.int32()), pa.array(out.ravel()))

    return sums


def guarded(fn: Callable, kind: T.DataType | str) -> Encoder:
    """A hook from a function of one value that may raise: it gives (value, error), so that one text that a
    model cannot take fails its own document and not the batch. Nulls are passed over."""
    kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    out = T.StructType([T.StructField("value", kind), T.StructField("error", T.StringType())])

    @F.pandas_udf(out)
    def run(s: pd.Series) -> pd.DataFrame:
        values, errors = [], []
        for x in s:
            value = error = None
            try:
                value = None if x is None else fn(x)
            except Exception as e:  # whatever a model raises becomes the document's message
                error = f"{type(e).__name__}: {e}"
            values.append(value)
            errors.append(error)
        return pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})

    def hook(c):
        return run(c)

    hook.guarded = True
    return hook


def outcome(hook: Encoder, c) -> Column:
    """struct<value, error> of any hook; one that is not guarded has no errors."""
    if getattr(hook, "guarded", False):
        return hook(c)
    return F.struct(hook(c).alias("value"), F.lit(None).cast("string").alias("error"))


def overlap_scorer(query, text) -> Column:
    """M2: share of the query's distinct words found in the text."""
    return let(F.array_distinct(words(query)), lambda q: F.when(
        F.size(q) > 0, F.size(F.array_intersect(q, words(text))) / F.size(q)).otherwise(F.lit(0.0)))


def label_scorer(text, labels, multi, full: int = 10) -> Column:
    """M3: a map of each label to how often the text names it, in either case, `full` times or more
    being 1. Single- and multi-label dimensions are scored alike."""
    low = F.lower(text)

    def share(label):
        name = F.lower(label)
        n = (F.length(low) - F.length(F.replace(low, name, F.lit("")))) / F.nullif(F.length(name), F.lit(0))
        return F.least(F.lit(1.0), F.round(F.coalesce(n, F.lit(0.0)) / full, 4))

    return F.map_from_arrays(labels, F.transform(labels, share))


def summarize(text, summarizer: Encoder | None = None, max_words: int | None = None) -> Column:
    """M4: a model's first sentence when a model is given and answers, else the lead. The model
    is shown the whole text unless `max_words` bounds it."""
    if summarizer is None:
        return fallback_summary(text)
    return F.coalesce(model_summary_output(summarizer(model_summary_input(text, max_words))), fallback_summary(text))


def nfkc() -> Encoder:
    """M6: Unicode compatibility normalisation; nulls pass through. A batch stays in Arrow's buffers, few of its
    texts at a time are Python strings; unused memory is given back after each batch."""

    @F.arrow_udf(T.StringType())
    def normalize(s: pa.Array) -> pa.Array:
        import ctypes
        from unicodedata import normalize

        import pyarrow as pa

        parts = [pa.array([None if x is None else normalize("NFKC", x) for x in s.slice(at, 64).to_pylist()], s.type)
                 for at in range(0, len(s), 64)]
        out = pa.concat_arrays(parts) if parts else s
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass
        return out

    return normalize


def porter() -> Encoder:
    """M5: Porter (1980) stems. A worker remembers the stems of recent terms."""
    memo: dict[str, str] = {}

    @F.arrow_udf(T.StringType())
    def stem(s: pa.Array) -> pa.Array:
        import re

        import pyarrow as pa

        cons = "(?:[^aeiouy]|(?<![^aeiou])y|^y)"
        vowel = "(?:[aeiou]|(?<=[^aeiou])y)"
        some = re.compile(f"^{cons}*{vowel}+{cons}")
        many = re.compile(f"^{cons}*(?:{vowel}+{cons}+){{2,}}{vowel}*$")
        once = re.compile(f"^{cons}*{vowel}+{cons}+{vowel}*$")
        has_vowel = re.compile(vowel)
        short = re.compile(f"{cons}{vowel}(?![wxy]){cons}$")
        double = re.compile(r"([^aeiouylsz])\1$")
        second = {
            "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
            "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
            "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
            "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
            "logi": "log",
        }
        third = {
            "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
        }
        fourth = [
            "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
            "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
        ]

        def longest(word, suffixes):
            return max((x for x in suffixes if word.endswith(x)), key=len, default=None)

        def one(w):
            if len(w) < 3 or not w.isascii() or not w.isalpha():
                return w
            if w.endswith("sses") or w.endswith("ies"):
                w = w[:-2]
            elif w.endswith("s") and not w.endswith("ss"):
                w = w[:-1]
            tail = longest(w, ["eed", "ed", "ing"])
            if tail == "eed":
                if some.search(w[:-3]):
                    w = w[:-1]
            elif tail and has_vowel.search(w[: -len(tail)]):
                w = w[: -len(tail)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double.search(w):
                    w = w[:-1]
                elif once.search(w) and short.search(w):
                    w += "e"
            if w.endswith("y") and has_vowel.search(w[:-1]):
                w = w[:-1] + "i"
            for table in (second, third):
                tail = longest(w, table)
                if tail and some.search(w[: -len(tail)]):
                    w = w[: -len(tail)] + table[tail]
            tail = longest(w, fourth)
            if tail and many.search(w[: -len(tail)]) and (tail != "ion" or w[-4] in "st"):
                w = w[: -len(tail)]
            if w.endswith("e"):
                base = w[:-1]
                if many.search(base) or (once.search(base) and not short.search(base)):
                    w = base
            if w.endswith("ll") and many.search(w[:-1]):
                w = w[:-1]
            return w

        if len(memo) > 1 << 18:
            memo.clear()
        # the batch's distinct terms only, each looked up by itself: what a batch costs does not grow with the memo
        coded = s.dictionary_encode()
        stems = []
        for w in coded.dictionary.to_pylist():
            known = memo.get(w)
            if known is None:
                known = memo[w] = one(w)
            stems.append(known)
        return pa.array(stems, coded.dictionary.type).take(coded.indices)

    return stem

