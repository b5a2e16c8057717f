"""The counting of K2: texts of a batch are cut, counted and scored as arrays, without an object for a word."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.codepoints import BLANK, DIGIT, GAP, LETTER, UPPER, text_tools

PIECE = 1 << 21  # bytes of text that are looked at together; a longer text is a piece of its own


def scored_phrases(docs: DataFrame, n: int, stopwords: Iterable[str], first: int, piece: int = PIECE) -> DataFrame:
    """(doc_id, phrases, others): every word and, from n = 2 on, pair of neighbours of (doc_id, text) with its score.

    `phrases` has the `first` with the least scores, and those whose score differs from the last of
    them by no more than a rounding; `others` has all that come after them.

    Sentences end after `.`, `!` or `?` with white space and at line ends; those without a letter
    don't count. Words are neighbours inside a run without punctuation. Stop words count as
    neighbours, but are no terms. A row stays in its task.
    """
    kind_of, runs, coded, pieces = text_tools(docs.sparkSession)
    unwanted = sorted(set(stopwords))
    letter, digit, capital, blank, gap = LETTER, DIGIT, UPPER, BLANK, GAP
    kind = T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("key", T.StringType())]))
    out = T.StructType([docs.schema["doc_id"], T.StructField("phrases", kind), T.StructField("others", kind)])
    best = first

    def scan(batches):
        import ctypes

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        stop = pa.array(unwanted, pa.string())

        def tokens(data, offsets):
            """Words in text order: their bytes, row, sentence (from 0 over the piece), run and whether they begin a sentence."""
            row_starts = np.unique(offsets[:-1][offsets[:-1] < len(data)])
            kind = kind_of(data)
            inside = (kind & (letter | digit)) > 0
            first, last = runs(inside, offsets)
            cut = data == 10
            mark = (kind & (letter | digit | gap)) == 0
            a, b = runs((kind & blank) > 0, offsets)
            ender = np.isin(data[a - 1], np.frombuffer(b".!?", np.uint8)) & (a > 0) & ~np.isin(a, row_starts)
            a, b = a[ender], b[ender]
            cut[a] = True
            long = b - a > 1
            for x, y in zip(a[long], b[long]):  # the sentence's end takes all of its white space
                cut[x + 1:y] = False
                mark[x:y] = False
            mark[a] = False
            cut[row_starts] = True
            sentence = np.cumsum(cut, dtype=np.int32)
            marks = np.cumsum(mark, dtype=np.int32)
            at = np.flatnonzero(cut)
            base = marks[at] - mark[at]
            s = sentence[first] - 1
            row = np.searchsorted(offsets, first, "right") - 1
            return inside, first, last, row, s, marks[first], marks[first] == base[s]

        def looks(known):
            """Of distinct words: whether they are capitals only (two or more), begin with one, hold a letter, hold a digit."""
            _, ends, data = known.buffers()
            ends = np.frombuffer(ends, np.int32)[known.offset:known.offset + len(known) + 1]
            data = np.frombuffer(data, np.uint8)[:ends[-1]]
            kind = kind_of(data)
            every, any_ = np.bitwise_and.reduceat(kind, ends[:-1]), np.bitwise_or.reduceat(kind, ends[:-1])
            several = pc.utf8_length(known).to_numpy() > 1
            return several & ((every & capital) > 0), (kind[ends[:-1]] & capital) > 0, (any_ & letter) > 0, (any_ & digit) > 0

        def grouped(key):
            """Order, starts and sizes of groups of equal keys; the order inside a group stays."""
            order = np.argsort(key, kind="stable")
            k = key[order]
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            start = np.flatnonzero(new)
            return order, start, np.diff(np.append(start, len(k))), np.cumsum(new) - 1

        def phrases(data, offsets):
            """Row, score and text of all phrases of a piece."""
            none = np.zeros(0, np.int64), np.zeros(0), pa.array([], pa.string())
            if not len(data):
                return none
            inside, first, last, row, sentence, run, opening = tokens(data, offsets)
            if not len(first):
                return none
            raw, known = coded(data, inside, first, last)
            lower = pa.array("\n".join(known.to_pylist()).lower().split("\n"), pa.string()).dictionary_encode()
            terms, m, low = lower.dictionary, len(lower.dictionary), lower.indices.to_numpy().astype(np.int64)
            usable = (pc.utf8_length(terms).to_numpy() >= 3) & ~pc.is_in(terms, value_set=stop).to_numpy(zero_copy_only=False)
            term = low[raw]
            upper, big, lettered, digits = (x[raw] for x in looks(known))
            good = usable[term] & ~digits
            # sentences that have a letter are counted, by row
            kept = sentence[lettered]
            kept = kept[np.diff(kept, prepend=-1) != 0]
            n_rows = len(offsets) - 1
            row_of = np.zeros(sentence[-1] + 1, np.int64)
            row_of[sentence] = row
            n_sents = np.bincount(row_of[kept], minlength=n_rows)
            before = np.cumsum(n_sents) - n_sents
            # neighbours
            fresh = np.ones(len(first), bool)
            fresh[1:] = (sentence[1:] != sentence[:-1]) | (run[1:] != run[:-1])
            prev, then = np.full(len(first), -1), np.full(len(first), -1)
            prev[1:] = np.where(fresh[1:], -1, term[:-1])
            then[:-1] = np.where(fresh[1:], -1, term[1:])
            proper = big & ~(fresh & opening) & ~upper
            at = np.flatnonzero(good)
            if not len(at):
                return none
            order, start, tf, group = grouped(row[at] * m + term[at])
            occ = at[order]
            g_row, g_term = row[occ[start]], term[occ[start]]
            sent = np.searchsorted(kept, sentence[occ]) - before[row[occ]]

            def variety(of):
                has = of[occ] >= 0
                seen = np.bincount(group[has], minlength=len(tf))
                pair = np.sort(group[has] * m + of[occ][has])
                different = np.bincount(pair[np.diff(pair, prepend=-1) != 0] // m, minlength=len(tf))
                return np.divide(different, seen, out=np.zeros(len(tf)), where=seen > 0)

            spread = np.bincount(group[np.append(True, (group[1:] != group[:-1]) | (sent[1:] != sent[:-1]))], minlength=len(tf))
            middle = (sent[start + (tf - 1) // 2] + sent[start + tf // 2]) / 2
            cased = np.maximum(np.bincount(group[upper[occ]], minlength=len(tf)), np.bincount(group[proper[occ]], minlength=len(tf)))
            k = np.bincount(g_row, minlength=n_rows)
            one, two = np.bincount(g_row, tf, n_rows), np.bincount(g_row, tf * tf.astype(float), n_rows)
            most = np.zeros(n_rows, np.int64)
            np.maximum.at(most, g_row, tf)
            some = np.maximum(k, 1)
            usual = (one / some + np.sqrt(np.maximum(k * two - one * one, 0.0)) / some)[g_row]
            rel = 1 + (variety(prev) + variety(then)) * tf / most[g_row]
            h = rel * np.log(np.log(middle + 3)) / (cased / (1 + np.log(tf)) + (tf / usual) / rel + (spread / n_sents[g_row]) / rel)
            rows, scores, keys = [g_row], [h / (tf * (1 + h))], [terms.take(pa.array(g_term))]
            if n >= 2:
                group_of = np.empty(len(at), np.int64)  # in text order
                group_of[order] = group
                left = np.flatnonzero((np.diff(at) == 1) & ~fresh[at[1:]])
                a, b = group_of[left], group_of[left + 1]
                order, start, times, _ = grouped(a * len(tf) + b)
                a, b = a[order[start]], b[order[start]]
                rows.append(g_row[a])
                scores.append(h[a] * h[b] / (times * (1 + (h[a] + h[b]))))
                keys.append(pc.binary_join_element_wise(terms.take(pa.array(g_term[a])), terms.take(pa.array(g_term[b])), " "))
            rows = np.concatenate(rows)
            scores = np.concatenate(scores)
            order = np.lexsort((scores, rows))
            return rows[order], scores[order], pa.concat_arrays(keys).take(pa.array(order))

        def split(row, score, n_rows):
            """Which phrases, in order, are among the first of their row."""
            count = np.bincount(row, minlength=n_rows)
            begin = np.cumsum(count) - count
            place = np.arange(len(row)) - begin[row]
            gap = np.ones(len(row), bool)  # a phrase that can't round to the same score as the one before
            gap[1:] = (row[1:] != row[:-1]) | (np.diff(score) > 1e-11 * np.maximum(1, np.abs(score[1:])))
            later = np.where(gap & (place >= best), place, len(row))
            cut = np.full(n_rows, len(row))
            np.minimum.at(cut, row, later)
            return place < cut[row]

        def lists(row, score, key, n_rows):
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=n_rows)))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(score), key], ["score", "key"]))

        try:
            for batch in batches:
                for i, j, data, offsets in pieces(batch.column("text"), piece):
                    row, score, key = phrases(data, offsets)
                    ahead = split(row, score, j - i)
                    parts = [lists(row[x], score[x], key.filter(pa.array(x)), j - i) for x in (ahead, ~ahead)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *parts], ["doc_id", "phrases", "others"])
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return docs.select("doc_id", "text").mapInArrow(scan, out)
