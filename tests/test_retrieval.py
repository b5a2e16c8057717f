import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from checks import inputs as I
from docspark.functions import hooks
from docspark.operators import classify as CL, fusion, keywords as KW, lexical, vectors as V
from docspark.plans.search import hybrid_search

DOCS = ["alpha beta gamma", "beta beta delta neural network", "neural words network", "épsilon alpha alpha", "", "network neural neural network"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")


def qs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_query_terms(spark):
    got = dict(map(tuple, lexical.query_terms(qs(spark, "The alpha of a Beta beta", "the of", "a", "", "naïve snake_case \"x1\"")).collect()))
    assert got == {0: ["alpha", "beta", "beta"], 1: ["the", "of"], 4: ["naïve", "snake_case", "x1"]}


def brute_bm25(items):
    toks = [d.replace("é", "e").split() for d in DOCS]
    avg = sum(map(len, toks)) / len(toks)
    def tf(t, item):
        return sum(t[i:i + len(item)] == item for i in range(len(t)))
    scores = {}
    for item in items:
        n = sum(tf(t, item) > 0 for t in toks)
        idf = max(math.log((len(toks) - n + .5) / (n + .5)), 1e-6)
        for k, t in enumerate(toks):
            f = tf(t, item)
            if f:
                scores[k] = scores.get(k, 0) + idf * f * 2.2 / (f + 1.2 * (.25 + .75 * len(t) / avg))
    return scores


@pytest.mark.parametrize("terms, phrases", [(["alpha"], []), (["beta", "beta", "delta"], []), (["gamma"], ["neural network"]), (["neural_network", "epsilon"], [])])
def test_bm25_with_phrases(spark, docs, terms, phrases):
    t = spark.createDataFrame([(0, terms)], "query_id long, terms array<string>")
    p = spark.createDataFrame([(0, x) for x in phrases], "query_id long, phrase string")
    items = lexical.match_items(t, p)
    got = {r.doc_id: r.bm25 for r in lexical.bm25(items, lexical.build_postings(docs), lexical.doc_stats(docs)).collect()}
    want = brute_bm25([x.replace("_", " ").split() for x in terms + phrases])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_inline_index_equals_stored_index(spark, docs):
    q = qs(spark, "alpha neural_network", "beta")
    stem = hooks.porter()
    a = lexical.keyword_ranks(q, docs, stemmer=stem)
    b = lexical.keyword_ranks(q, docs, stemmer=stem, postings=lexical.build_postings(docs, stem), stats=lexical.doc_stats(docs))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) != []


def vecs(rng, n, dim=8):
    out = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(n)]
    for i in range(0, n, 3):   # a third of the rows are copies
        out[i] = out[0]
    return out


@pytest.mark.parametrize("ship", [4096, 2, 7])
def test_vector_topk_is_exact(spark, ship):
    rng = random.Random(5)
    vs, q = vecs(rng, 60), vecs(rng, 9)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = {(i, r + 1): c for i, a in enumerate(q) for r, c in enumerate(sorted(range(60), key=lambda c: (-round(cos(a, vs[c]), 10), c))[:7])}
    left = spark.createDataFrame(list(enumerate(vs)), "chunk_id long, embedding array<double>").repartition(3)
    right = spark.createDataFrame(list(enumerate(q)), "query_id long, embedding array<double>")
    got = {(r.query_id, r.sem_rank): r.chunk_id for r in V.vector_topk(right, left, 7, ship).collect()}
    assert got == want


def test_finite_and_zero_vectors(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [nan, 0.0]), (2, [inf, 0.0]), (3, [0.0, -inf]), (4, [0.0, 0.0]), (5, [-1.0, 0.0])], "chunk_id long, embedding array<float>")
    good = V.finite_vectors(df)
    assert sorted(r.chunk_id for r in good.collect()) == [0, 4, 5]
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert {r.chunk_id: r.similarity for r in V.vector_topk(q, good).collect()} == {0: 1.0, 4: 0.0, 5: 0.0}


def test_fusion_penalty_ties_and_pool(spark):
    kw = spark.createDataFrame([(0, 10, 1), (0, 11, 2), (0, 99, 3)], "query_id long, doc_id long, kw_rank int")
    sem = spark.createDataFrame([(0, 10 + i % 4, f"c{i:02d}", i + 1, 0.5) for i in range(40)] + [(1, 10, "c00", 1, 0.9)],
                                "query_id long, doc_id long, chunk_id string, sem_rank int, similarity double")
    fused = fusion.rrf(kw, sem)
    r = {(x.query_id, x.chunk_id): (x.kw_rank, x.score) for x in fused.collect()}
    assert r[0, "c00"] == (1, round(2 / 61 + 1 / 61, 6)) and r[0, "c02"] == (63, round(2 / 123 + 1 / 63, 6))
    assert r[1, "c00"] == (60, round(2 / 120 + 1 / 61, 6))
    for limit, n in ((1, 15), (5, 15), (6, 18), (30, 30), (36, 36), (50, 40)):
        assert fusion.rerank_pool(fused.filter("query_id = 0"), limit).count() == n
    with pytest.raises(ValueError):
        fusion.pool_size(0)
    pool = fusion.rerank_pool(fused.filter("query_id = 0"), 50)
    docs = spark.createDataFrame([(10, "f", "s", ["a"]), (12, "g", "s", ["b"])], "doc_id long, filename string, summary string, tags array<string>")
    hits = fusion.attach_metadata(pool, docs)
    assert {x.doc_id for x in hits.collect()} == {10, 12}
    ranks = sorted(x.rank for x in fusion.top_hits(fusion.fused_order(hits), 50).collect())
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) <= 40


def test_rerank_orders_and_single_hit(spark):
    df = spark.createDataFrame([(0, "x", 1, "cat dog", "cat"), (0, "y", 2, "cat dog", "dog cat"), (0, "z", 3, "cat dog", None), (1, "x", 1, "q", "q")],
                               "query_id long, chunk_id string, fused_rank int, query string, text string")
    got = {(r.query_id, r.chunk_id): (r.rank, r.ce_score) for r in fusion.rerank(df).collect()}
    assert got[0, "y"] == (1, 1.0) and got[0, "x"] == (2, 0.5) and got[0, "z"][0] == 3 and got[1, "x"] == (1, None)


def test_hybrid_search_end_to_end(spark, docs):
    cat = docs.select("doc_id", F.concat(F.lit("f"), "doc_id").alias("filename"), F.lit("s").alias("summary"), F.array(F.lit("t")).alias("tags"))
    v = docs.select(F.concat(F.col("doc_id"), F.lit("_chunk_0")).alias("chunk_id"), "doc_id", F.lit(1).alias("page"), "text", hooks.hash_encoder("text").alias("embedding"))
    q = qs(spark, "neural network words together here", "  ", "épsilon")
    out = hybrid_search(q, cat, docs, v, limit=3, encoder=hooks.hash_encoder, stemmer=hooks.porter(), expand=True, scorer=hooks.overlap_scorer).collect()
    first = {r.query_id: r.doc_id for r in out if r["rank"] == 1}
    assert first == {0: 2, 2: 3} and all(r["rank"] <= 3 for r in out)
    empty = hybrid_search(q, cat, docs, v.filter("false"), encoder=hooks.hash_encoder)
    assert empty.count() == 0


def test_hash_encoder(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string").select(hooks.hash_encoder("t").alias("v")).collect()
    assert len(df[0].v) == 64 and abs(sum(x * x for x in df[0].v) - 1) < 1e-12
    assert set(df[1].v) == {0.0} and set(df[2].v) == {0.0}


def test_keyphrases_find_the_planted_phrase(spark):
    text = " ".join(f"The {w} thing uses Quantum Annealing for {w}." for w in "solving planning routing packing cutting folding mixing sorting storing".split())
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    got = KW.keyphrases(docs, 5).orderBy("pos").collect()
    assert {r.doc_id for r in got} == {1} and len(got) == 5
    assert "quantum annealing" in [r.phrase for r in got[:3]]
    assert [r.score for r in got] == sorted(r.score for r in got)


def test_expand_query_needs_four_words(spark):
    got = KW.expand_query(qs(spark, "three short words", "deep convolutional networks for image recognition")).collect()
    assert {r.query_id for r in got} == {1} and 0 < len(got) <= 3 and all(" " in r.phrase for r in got)


def test_content_keywords_cascade(spark):
    docs = spark.createDataFrame([(1, "f.txt", "zebra zebra 12345 abc"), (2, "my Syllabus.txt", "of the")], "doc_id long, filename string, text string")
    got = [r.tag for r in KW.content_keywords(docs, 3, encoder=hooks.hash_encoder).filter("doc_id = 1").orderBy("pos").collect()]
    assert "Zebra" in got and all(len(t) >= 4 and not t[0].isdigit() for t in got) and len(got) == len(set(got))
    tags = {r.doc_id: r.tags for r in KW.rule_based_tags(docs).collect()}
    assert tags[2] == ["Syllabus"] and "Zebra" in tags[1]


def test_tf_terms_and_frequent_words(spark):
    docs = spark.createDataFrame([(1, "Red apple, the red apple and green apples. tree42 trees trees")], "doc_id long, text string")
    tf = {r.phrase: r.tf for r in KW.tf_terms(docs).collect()}
    assert tf["red apple"] == 2 and tf["apple green"] == 1 and "the" not in tf
    assert [(r.phrase, r.tf) for r in KW.frequent_words(docs).orderBy("pos").collect()] == [("apple", 2), ("trees", 2)]


def test_semantic_candidates_floor(spark):
    docs = spark.createDataFrame([(1, "Zebra zebra zebra. The zebra runs")], "doc_id long, text string")
    got = KW.semantic_candidates(docs, hooks.hash_encoder).orderBy("pos").collect()
    assert got[0].phrase.lower().startswith("zebra") and all(r.score > 0.45 for r in got)


def test_exclude_labels(spark):
    tags = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Report", "a", "SCIENCE", *"bcdefghij"])], "doc_id long, pos int, tag string")
    cats = spark.createDataFrame([("x", "A")], "dimension_id string, name string")
    assert [r.tag for r in KW.exclude_labels(tags, CL.label_union(cats)).orderBy("pos").collect()] == list("bcdefghi")


def test_classify_thresholds(spark):
    dims = spark.createDataFrame([("m", "M", True, 1), ("s", "S", False, 2)], "dimension_id string, display_name string, is_multi_label boolean, dim_order int")
    lab = spark.createDataFrame([(d, n, v) for d in "ms" for n, v in (("a", [1.0, 0.0]), ("b", [0.0, 1.0]))], "dimension_id string, label string, embedding array<double>")
    deg = lambda x: [math.cos(math.radians(x)), math.sin(math.radians(x))]
    docs = spark.createDataFrame([(1, deg(45)), (2, deg(-68)), (3, deg(-90)), (4, deg(10))], "doc_id long, embedding array<double>")
    got = {r.doc_id: r.classifications for r in CL.classify(docs, dims, lab).collect()}
    assert got == {1: {"m": ["a", "b"], "s": ["a"]}, 2: {"s": ["a"]}, 4: {"m": ["a"], "s": ["a"]}}


def test_keyphrases_move_no_token(spark):
    text = "Red foxes met NATO, a red fox. NATO met Ann; red foxes ran!\nAnn saw red foxes: red foxes saw Ann."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "of the 12 ab"), (4, "<b>One</b>")], "doc_id long, text string")
    got = KW.keyphrases(docs, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Window", "Aggregate", "Sort "))
    rows = got.collect()
    assert [(r.doc_id, r.pos) for r in rows if r.doc_id == 1] == [(1, p) for p in range(4)] and {r.doc_id for r in rows} == {1, 4}
    assert "red foxes" in [r.phrase for r in rows] and KW.keyphrases(docs, 9, n=1).where("phrase LIKE '% %'").count() == 0


def test_classify_with_moves_results_only(spark):
    dims = spark.createDataFrame([("m", "M", True, 1), ("s", "S", False, 2)], "dimension_id string, display_name string, is_multi_label boolean, dim_order int")
    cats = spark.createDataFrame([(d, x) for d in "ms" for x in ("aa", "bb", "cc", "dd")], "dimension_id string, name string")
    docs = spark.createDataFrame([(1, "aa " * 6 + "bb " * 8), (1, "cc " * 9), (2, "dd " * 4), (3, None), (4, "")], "doc_id long, text string")
    got = CL.classify_with(docs, dims, cats)
    assert got._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(doc_id#") == 1
    assert {r.doc_id: r.classifications for r in got.collect()} == {1: {"m": ["cc", "bb", "aa"], "s": ["cc"]}, 2: {"s": ["dd"]}}


def test_cosine_of_odd_rows_a_batch_at_a_time(spark):
    nan = float("nan")
    rows = [(0, [3.0, 4.0], [3.0, 4.0]), (1, [1.0, 0.0], [0.0, 2.0]), (2, [0.0, 0.0], [1.0, 1.0]), (3, None, [1.0, 1.0]),
            (4, [1.0, None], [1.0, 1.0]), (5, [1.0], [1.0, 1.0]), (6, [nan, 1.0], [1.0, 1.0]), (7, [-2.0, 0.0], [1.0, 0.0]), (8, [], [])]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>").coalesce(1).select("i", V.cosine(F.col("a"), F.col("b")).alias("c"))
    got = [r["c"] for r in df.orderBy("i").collect()]
    assert [round(x, 9) if x is not None and x == x else x for x in got[:6] + got[7:]] == [1.0, 0.0, 0.0, 0.0, 0.0, None, -1.0, 0.0]
    assert got[6] != got[6]
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()  # before: lambdas over single components


def test_phrase_matches_against_brute_force(spark):
    rng = random.Random(5)
    texts = {i: [rng.choice("abc") for _ in range(rng.randrange(0, 40))] for i in range(30)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    phrases = ["a b", "a a", "a b a", "b c a b", "a z"]
    items = lexical.match_items(spark.createDataFrame([(k, [p.replace(" ", "_")]) for k, p in enumerate(phrases)], "query_id long, terms array<string>"))
    found = lexical.phrase_matches(items, lexical.build_postings(docs))
    want = {}
    for p in map(str.split, phrases):
        for i, t in texts.items():
            n = sum(t[j:j + len(p)] == p for j in range(len(t)))
            if n:
                want[" ".join(p), i] = n
    assert {(r["item"], r["doc_id"]): r["tf"] for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(transform(positions" not in plan  # before: a row for every position of every token


@pytest.mark.parametrize("terms, weights, batch", [(16_384, 65_536, 10_000), (16_384, 65_536, 7), (3, 65_536, 7), (16_384, 3, 7)])
def test_best_documents_are_found_where_the_rows_are(spark, monkeypatch, terms, weights, batch):
    """Any bound on what is sent to tasks gives the ranks of the whole sum; within the bounds, no sums of all pairs are exchanged."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(0, 12))) for _ in range(150)] + ["aa bb"] * 40 + ["", None, "zz"]
    docs = spark.createDataFrame([(i, t, f"aa{i}.txt") for i, t in enumerate(texts)], "doc_id long, text string, filename string").repartition(3)
    q = qs(spark, "aa bb", "cc dd ee cc", "aa", "nowhere", "zz hh nowhere", "")
    items = lexical.match_items(lexical.query_terms(q))
    want = lexical.rank_keyword(lexical.bm25(items, lexical.build_postings(docs), lexical.doc_stats(docs)), 10)
    monkeypatch.setattr(lexical, "SHIP_TERMS", terms)
    monkeypatch.setattr(lexical, "SHIP_WEIGHTS", weights)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = lexical.keyword_ranks(q, docs, top=10)
        rows = lambda df: sorted((r.query_id, r.doc_id, r.kw_rank, round(r.bm25, 6)) for r in df.collect())
        assert rows(got) == rows(want) and {r[0] for r in rows(got)} == {0, 1, 2, 4}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = re.search(r"hashpartitioning\(query_id#\d+L, doc_id#\d+L", got._jdf.queryExecution().executedPlan().toString())
    assert (pairs is None) == (min(terms, weights) > 3)


def test_catalog_of_looked_up_documents_only(spark):
    """What is not looked up is dropped before any column is derived."""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    some = spark.createDataFrame([(i,) for i in (3, 5, 5, 10**9)], "doc_id long")
    for tags in (False, True):
        whole = I.catalog(spark, "/root/testdata/sf0.001", tags).where("doc_id IN (3, 5)")
        part = I.catalog(spark, "/root/testdata/sf0.001", tags, only=some)
        assert sorted(map(str, part.collect())) == sorted(map(str, whole.collect())) and part.count() == 2
    plan = I.catalog(spark, "/root/testdata/sf0.001", False, only=some)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") > plan.index("AS summary")
