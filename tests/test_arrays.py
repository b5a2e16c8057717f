"""Steps that cut and count texts as arrays of a batch, against counting them word by word."""
import unicodedata
from collections import defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from docspark.functions.hooks import DIMENSIONS, hash_encoder, porter
from docspark.functions.text import fallback_summary, key_findings, lead_and_findings
from docspark.operators import keywords, lexical, phrases
from docspark.functions import constants as K

TEXTS = {
    1: "Alpha beta Gamma. \x1cDelta alpha Beta, GAMMA beta!\nÉclair naïve straße ΣΊΣΥΦΟΣ İstanbul Éclair. 日本語 x_y alpha1 the Alpha",
    2: None, 3: "", 4: "  \n .", 5: "12 34_5", 6: "one", 7: "été ÉTÉ été 𝔘𝔫𝔦 Ⅷ ١٢ x \U000f0000y", 8: "Alpha beta. " * 300, 9: "ends with word",
    10: "starts here. It is DUE by noon for everyone in this room. A  \t b  c\n\nd. deadliné is not a signal in this long sentence at all.",
}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").coalesce(1).cache()


#: As counted inside the row, by column expressions.
WANTED = [(0, "alpha beta", 0.10211), (1, "alpha", 0.130045), (2, "beta", 0.144897), (3, "σίσυφος i̇stanbul", 0.150467), (4, "gamma", 0.155765)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _runs(text, inside):
    out, word = [], ""
    for c in text + " ":
        if inside(c):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def test_postings_are_counted_as_arrays(odd, monkeypatch):
    want = {}
    folded = {r[0]: r[1] or "" for r in odd.select("doc_id", lexical.fold("text")).collect()}
    for k, text in folded.items():
        at = defaultdict(list)
        for i, t in enumerate(_runs(text, lambda c: unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co")):
            at[t].append(i)
        want[k] = [(t, len(at[t]), at[t]) for t in sorted(at, key=lambda t: t.encode())]
    for piece in (1, 1 << 21):  # a text each, or all of them at once
        monkeypatch.setattr(lexical, "PIECE", piece)
        rows = lexical.document_terms(odd, positions=True, lengths=True)
        assert "MapInArrow" in plan(rows) and "sort_array" not in plan(rows)
        got = {r[0]: ([(e.term, e.tf, e.positions) for e in r[1]], r[2]) for r in rows.collect()}
        assert got == {k: (x, sum(e[1] for e in x)) for k, x in want.items()}
        some = {r[0]: ([e.term for e in r[1]], r[2]) for r in lexical.document_terms(odd, False, True, ["alpha", "ete"]).collect()}
        assert some == {k: ([e[0] for e in x if e[0] in ("alpha", "ete")], sum(e[1] for e in x)) for k, x in want.items()}


def test_only_terms_with_wanted_stems_are_counted(spark, odd, monkeypatch):
    docs = spark.createDataFrame([(1, "Running runs runner run, ran."), (2, None), (3, "the runs of others ran runs"), (4, "words")], "doc_id long, text string")
    docs = docs.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10))
    only = spark.createDataFrame([("run",), ("alpha",), ("nothing",)], "term string")
    every = lexical.build_postings(docs, porter(), True, lengths=True).join(only, "term", "left_semi")
    want = sorted(tuple(r) for r in every.select("doc_id", "term", "tf", "positions", "dl").collect())
    counted = []
    terms = lexical.document_terms
    monkeypatch.setattr(lexical, "document_terms", lambda *a: counted.append(a[3]) or terms(*a))
    for most in (lexical.SHIP_TERMS, 1):  # with a list of terms, and too many for one
        monkeypatch.setattr(lexical, "SHIP_TERMS", most)
        rows = lexical.build_postings(docs, porter(), True, only, lengths=True)
        assert sorted(tuple(r) for r in rows.select("doc_id", "term", "tf", "positions", "dl").collect()) == want
    assert sorted(counted[0]) == ["alpha", "run", "running", "runs"] and counted[1] is None
    assert ("run", 2, [1, 5]) in [r[1:4] for r in want if r[0] == 3]


def test_hash_encoder_cuts_texts_itself(odd):
    low = {r[0]: r[1] or "" for r in odd.select("doc_id", F.lower("text")).collect()}
    got = odd.select("doc_id", hash_encoder("text").alias("v"))
    assert "regexp_extract_all" not in plan(got)
    for k, v in got.collect():
        want = [0.0] * DIMENSIONS
        for w in _runs(low[k], lambda c: unicodedata.category(c)[0] in "LN" or c == "_"):
            code = md5(w.encode()).digest()[0] % (2 * DIMENSIONS)
            want[code % DIMENSIONS] += 1 if code < DIMENSIONS else -1
        norm = sum(x * x for x in want) ** 0.5
        assert v == pytest.approx([x / norm if norm else 0.0 for x in want], abs=1e-12), k


def test_keyphrases_are_counted_as_arrays(odd):
    got = keywords.keyphrases(odd, 5)
    assert "MapInArrow" in plan(got) and "regexp_extract_all" not in plan(got)
    rows = [(r.pos, r.phrase, round(r.score, 6)) for r in got.where("doc_id = 1").orderBy("pos").collect()]
    assert rows == WANTED
    assert {r[0] for r in got.select("doc_id").distinct().collect()} == {1, 7, 8, 9, 10, 6}


def test_no_phrase_is_lost_behind_the_first(odd):
    """With few phrases ahead and texts cut in pieces the choice is the same."""
    text = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def all_of(first, piece):
        rows = phrases.scored_phrases(text, 2, K.STOPWORDS, first, piece)
        return {r[0]: [(e.score, e.key) for e in r[1] + r[2]] for r in rows.collect()}, {r[0]: len(r[1]) for r in rows.collect()}
    many, _ = all_of(10_000, 1 << 21)
    few, ahead = all_of(2, 10)
    assert {k: sorted(v) for k, v in few.items()} == {k: sorted(v) for k, v in many.items()}
    assert ahead[1] >= 2 and all(a[0] <= b[0] for v in few.values() for a, b in zip(v, v[1:]))


def test_lead_and_findings_share_their_sentences(odd):
    m = odd.select("doc_id", lead_and_findings("text").alias("m"), fallback_summary("text").alias("s"), key_findings("text").alias("k")).collect()
    for r in m:
        assert (r.m.summary, r.m.key_findings) == (r.s, r.k)
    assert [x for r in m if r.doc_id == 10 for x in r.k] == ["It is DUE by noon for everyone in this room."]


def test_findings_start_with_a_known_character():
    for word in K.FINDING_SIGNAL[3:-3].split("|"):
        assert word[0] in K.FINDING_STARTS, word
