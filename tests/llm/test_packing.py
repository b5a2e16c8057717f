"""Packing: ids against the tokenizers library, sequences against their definition and a lower bound."""
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from docspark.llm import packing
from docspark.llm.packing import ALIKE, Encoder, cut, least_bins, pack, pack_group
from docspark.llm.queries import QUERIES, byte_tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(byte_tokenizer_path())


def test_code_points_that_both_libraries_class_alike(library):
    fast = Encoder(byte_tokenizer_path()).ready().fast
    points = [chr(c) for a, b in re.findall("(.)-(.)", ALIKE, re.S) for c in range(ord(a), ord(b) + 1)]
    assert len(points) > 30_000
    for i in range(0, len(points), 64):
        text = "".join(f"a{c}1{c} {c}.{c}\n{c} " for c in points[i:i + 64])
        assert library.encode(text, add_special_tokens=False).ids == fast.encode(text, allowed_special="all")


def texts(rng):
    some = "the Quick brown's fox 123 \t\n\n  don't été Füße Привет 日本語 한국 العربية हिन्दी 𝒳 😀 … — <|endoftext|> x" + "᳷⹝\U0001fae9఼"
    out = [None, "", " ", "<|endoftext|>", "a" * 9000, " " * 9000 + "x", "word " * 5000, "<|endoftext|>" * 2, "'s 'S 'LL"]
    return out + ["".join(rng.choice(some) for _ in range(rng.randint(1, 400))) for _ in range(150)] + ["tok " * k for k in (510, 1021, 1022, 1023, 1024, 2047, 3000)]


def test_cut_and_query(spark, library, tmp_path):
    rng = random.Random(4)
    rows = [(i, t, "x", i) for i, t in enumerate(texts(rng))] + [(3, "again", None, None), (None, "no id", None, None), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, length long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc, text, _, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want.append((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    cuts = cut(docs, byte_tokenizer_path()).collect()
    assert sorted(map(str, [(r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in cuts])) == sorted(map(str, want))
    got = QUERIES["op11_best_fit_packing"](spark, str(tmp_path)).collect()
    assert sorted(map(str, [tuple(r)[:5] for r in got])) == sorted(map(str, want))
    used = whole([(r["sequence_id"], r["offset"], r["length"]) for r in got], 1024)
    assert used == least_bins(np.array([w[3] for w in want]), 1024)


def whole(rows, size):
    """Checks that sequences are gapless and short enough; their number."""
    by = {}
    for s, a, n in rows:
        by.setdefault(s, []).append((a, n))
    for spans in by.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= size
    return len(by)


@pytest.mark.parametrize("low, high, size, count", [(1, 1025, 1024, 3000), (200, 700, 1024, 2000), (340, 520, 1024, 2000), (513, 1025, 1024, 500),
                                                    (1, 2, 1024, 5000), (1, 8, 7, 300), (100, 400, 1024, 2000)])
def test_search_beats_best_fit(monkeypatch, low, high, size, count):
    lengths = np.random.default_rng(low + count).integers(low, high, count)
    where, offset = pack_group(lengths, size)
    n = whole(zip(where.tolist(), offset.tolist(), lengths.tolist()), size)
    monkeypatch.setattr(packing, "local_search", lambda *_: None)
    plain = len(np.unique(pack_group(lengths, size)[0]))
    assert least_bins(lengths, size) <= n <= plain
    if (low, high) == (200, 700):
        assert n < plain


def test_exhaustive_optimum():
    rng = random.Random(8)

    def best(items, size):
        most, bins = [len(items)], []

        def place(k):
            if len(bins) >= most[0]:
                return
            if k == len(items):
                most[0] = len(bins)
                return
            for b in range(len(bins)):
                if bins[b] + items[k] <= size:
                    bins[b] += items[k]
                    place(k + 1)
                    bins[b] -= items[k]
            bins.append(items[k])
            place(k + 1)
            bins.pop()

        place(0)
        return most[0]

    more = 0
    for _ in range(60):
        items = [rng.randint(2, 14) for _ in range(8)]
        opt, got = best(items, 20), len(np.unique(pack_group(np.array(items), 20)[0]))
        assert least_bins(np.array(items), 20) <= opt <= got
        more += got - opt
    assert more <= 3


def test_pack_in_groups_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 400)
    rng = random.Random(5)
    rows = [(i // 2, rng.randint(1, 64), "s", None) for i in range(1500)] + [(1, None, "s", 1), (2, 0, None, 2), (3, 65, None, 3)] + [(9, 30, "t", 4)] * 50
    got = pack(spark.createDataFrame(rows, "doc_id long, n int, sequence_id string, extra long"), 64, "n").collect()
    assert sorted(map(str, [(r["doc_id"], r["n"], r["extra"]) for r in got])) == sorted(map(str, [(a, b, d) for a, b, _, d in rows]))
    fine = [r for r in got if r["n"] and r["n"] <= 64]
    assert all(r["sequence_id"] is None and r["offset"] is None for r in got if not (r["n"] and r["n"] <= 64))
    n = whole([(r["sequence_id"], r["offset"], r["n"]) for r in fine], 64)
    assert n <= least_bins(np.array([r["n"] for r in fine]), 64) * 1.02
    assert pack(spark.createDataFrame([], "length long")).count() == 0
    assert cut(spark.createDataFrame([], "doc_id long, text string"), byte_tokenizer_path()).count() == 0
