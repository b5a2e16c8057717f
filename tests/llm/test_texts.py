"""Text operators against brute force and exact round trips."""
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docspark.llm import chat
from docspark.llm.bpe import Codec, bpe_decode, bpe_encode
from docspark.llm.jaccard_join import similar_documents
from docspark.llm.langid import codewords, identify
from docspark.llm.mixing import classifier, copies, fit_rates, mix, mixing_rates, posteriors
from docspark.llm.ngram_lm import score_texts, train
from docspark.llm.suffix_dedup import PART, Shard, remove_repeats, repeated, common_prefixes, suffix_order
from docspark.llm.bytetext import chunks
from docspark.llm.toxicity import IDENTITY, Kind, _swaps, features, fit, score_texts as score_words, toxicity, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def corpus(seed=3, n=60):
    """Random texts with exact and near copies, shared passages, blanks, a long one, and nulls."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeghiornst") for _ in range(rng.randint(1, 8))) for _ in range(300)] + ["é", "ñandú", "ß", "中文"]
    words = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, texts = words(70), []
    for i in range(n):
        t = words(rng.randint(1, 120))
        if i % 7 == 3:
            t = t + " " + passage + " " + words(5)
        if i % 9 == 4:
            t = texts[i // 2]
        if i % 9 == 5:
            w = texts[i - 2].split() or ["x"]
            w[rng.randrange(len(w))] = "CHANGED"
            t = " ".join(w)
        texts.append(t)
    texts += ["", "   \t\n", None, "one", "One", "a b", words(4000), "a" * 300, "a" * 120 + "\0" * 60 + "a" * 60, "\0" * 200]
    return [(i, t, None, None, None, None) for i, t in enumerate(texts)]


WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def word_list(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


# --- n-gram Jaccard join

def brute_classes(rows, n, percent):
    sets = {}
    for i, t, *_ in rows:
        w = word_list(t)
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def mutated(seed, base_words=150, n=80):
    """Near copies of one text, at distances about the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(base_words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"m{rng.randrange(10**6)}"
        rows.append((i, " ".join(w[: len(w) - rng.randrange(0, 12)]), None, None, None, None))
    return rows


@pytest.mark.parametrize("rows,n,percent", [(corpus(), 3, 90), (corpus(8), 5, 80), (mutated(1), 3, 90), (mutated(2, 40), 5, 80), (mutated(3, 12, 60), 3, 70)])
def test_similar_documents(spark, rows, n, percent):
    members, links = similar_documents(spark.createDataFrame(rows, DOCS), n, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in members.collect()} == brute_classes(rows, n, percent)
    for r in links.collect():
        assert 100 * r["shared"] >= percent * (r["na"] + r["nb"] - r["shared"])


def test_similar_documents_of_nothing(spark):
    members, links = similar_documents(spark.createDataFrame([], DOCS))
    assert members.count() == 0 and links.count() == 0
    members, _ = similar_documents(spark.createDataFrame([(None, "a b c d e f", None, None, None, None)], DOCS))
    assert [tuple(r) for r in members.collect()] == [(None, 2, None)]


def test_postings_that_come_late_in_both_sets_are_not_tried(spark, monkeypatch):
    from docspark.llm import jaccard_join
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng, t = random.Random(3), 0.8
    rows = [(i, 100, 18 + k, k, i) for i in range(300) for k in range(3)]  # 18 words of its own each, then the template: similarity 0.69
    late = spark.createDataFrame(rows, "node long, size int, pos int, g long, component long")
    x, y = jaccard_join._sides(late, t)
    assert x.join(y, jaccard_join._BY).count() == 0
    sizes = [rng.randrange(20, 300) for _ in range(120)]
    mixed = [(1000 + i, n, rng.randrange(n // 5 + 1), g, 1000 + i // 2) for i, n in enumerate(sizes) for g in (0, 7)]
    x, y = jaccard_join._sides(late.union(spark.createDataFrame(mixed, late.schema)), t)
    tried = x.alias("x").join(y.alias("y"), jaccard_join._BY).select("g", "x.node", "x.size", "x.pos", "x.component", "y.node", "y.size", "y.pos", "y.component")
    got = {(g, *sorted((a, b))) for g, a, m, i, c, b, n, j, d in tried.collect() if c != d and i + j + abs(m - i - n + j) <= (1 - t) / (1 + t) * (m + n) + 1e-6}
    posts = [*late.collect(), *mixed]
    want = {(p[3], p[0], q[0]) for p in posts for q in posts if p[3] == q[3] and p[0] < q[0] and p[4] != q[4] and t * max(p[1], q[1]) <= min(p[1], q[1])
            and p[2] + q[2] + abs(p[1] - p[2] - q[1] + q[2]) <= (1 - t) / (1 + t) * (p[1] + q[1]) + 1e-6}
    assert want and want <= got and tried.count() < 120 * 420 * 2 // 2


# --- suffix-array dedup

def brute_cut(rows):
    first, out = {}, {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            first[b[s:s + 50]] = min(i, first.get(b[s:s + 50], i))
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s:s + 50]] < i:
                gone[s:s + 50] = True
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), [tuple(x) for x in edges.reshape(-1, 2).tolist()], hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_remove_repeats(spark, seed):
    rows = corpus(seed)
    rng = random.Random(seed)
    for i, t, *rest in list(rows)[:40]:  # pieces of texts inside others
        if t and len(t) > 80:
            at = rng.randrange(len(t) - 70)
            rows.append((len(rows), f"{rng.random()} {t[at:at + rng.randrange(45, 70)]} {rng.random()}", *rest))
    got = remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: (r["n_bytes"], [tuple(s) for s in r["removed"]], r["kept_sha256"]) for r in got} == brute_cut(rows)
    assert got[0].__fields__[:6] == ["doc_id", "text", "lang", "source", "n_chars", "score"]


def test_remove_repeats_of_nothing_and_of_equal_ids(spark):
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    text = "x" * 10 + "some text that is long enough to be cut, if it comes again"
    rows = [(1, text, None, None, None, None), (1, text, None, None, None, None), (None, text, None, None, None, None)]
    got = remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r["doc_id"]), len(r["text"])) for r in got) == [("1", len(text)), ("1", len(text)), ("None", 0)]


def test_no_content_shard_gets_all_that_surrounds_a_frequent_gram(spark, monkeypatch):
    rng = random.Random(8)
    rows, line = corpus(5), " -- all rights are reserved -- "
    some = [line.join("".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(3)) for _ in range(12)]
    for i in range(len(rows), len(rows) + 150):  # the line with other text around it in each; some have whole windows over it in common
        own = "".join(rng.choice("abcdefgh ") for _ in range(90))
        rows.append((i, rng.choice([own + line + own[::-1], own[:20] + rng.choice(some)[rng.randrange(40):], line * 3 + own]), None, None, None, None))

    def bounded(hashes, text, doc):
        assert np.unique(hashes, return_counts=True)[1].max() <= 20, "one judge task gets every text around an anchor"
        return repeated(hashes, text, doc)

    for name, value in (("HOT", 20), ("SHARD_BYTES", 1 << 13), ("repeated", bounded)):
        monkeypatch.setattr(f"docspark.llm.suffix_dedup.{name}", value, raising=False)
    got = remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: (r["n_bytes"], [tuple(s) for s in r["removed"]], r["kept_sha256"]) for r in got} == brute_cut(rows)


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, (50, 84)).astype(np.uint8)
    text[10:30] = text[:20]
    length = rng.integers(1, 85, 50)
    order, inverse = suffix_order(text, length)
    suffixes = [text[i // 84, i % 84:length[i // 84]].tobytes() for i in order]
    assert suffixes == sorted(suffixes) and len(order) == length.sum()
    common = common_prefixes(text, length, order, inverse)
    for a, b, h in zip(suffixes, suffixes[1:], common[1:]):
        assert a[:h] == b[:h] and (len(a) == h or len(b) == h or a[h] != b[h])


def test_parts_of_a_content_shard_are_merged(monkeypatch):
    rng = np.random.default_rng(1)
    text = np.zeros((200, 88), np.uint8)
    text[:, :84] = rng.integers(97, 123, 84)
    text[:, :84][np.arange(200), rng.integers(0, 34, 200)] = 65
    text[:, 85] = 84
    doc, hashes = rng.permutation(200).astype(np.int64), np.full(200, 7, np.uint64)
    whole = repeated(hashes, text, doc)
    monkeypatch.setattr("docspark.llm.suffix_dedup.PART", 16)
    assert PART > 200 and (repeated(hashes, text, doc) == whole).all() and whole.any()


def test_texts_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    rng = np.random.default_rng(2)
    text = np.zeros((60, 88), np.uint8)
    text[:, :84] = rng.integers(97, 123, (4, 84))[rng.integers(0, 4, 60)]
    text[:, 85] = 84
    doc, hashes = rng.permutation(60).astype(np.int64), np.full(60, 7, np.uint64)
    right = repeated(hashes, text, doc)
    monkeypatch.setattr("docspark.llm.suffix_dedup._row_hash", lambda text, hashes: hashes)
    assert (repeated(hashes, text, doc) == right).all() and (right == 0).sum() == 4
    texts = [bytes(x).decode() for x in np.unique(text[:, :84], axis=0)]
    shard = Shard(pa.table({"doc_id": range(8), "text": [texts[i % 4] for i in range(8)], "carried": [{"x": 1}] * 8}))
    p, doc, cls, _, around, least = shard.contexts(np.unique(shard.hash), shard.hash[:0])
    assert (least[cls] == doc % 4).all() and len(around) == len(p) // 2


# --- BPE

def test_bpe_matches_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    pool = "aabcdethinganr eo  ÀéßİΣσςñ 中文字 0123 '''s're!?.. \t\n\x1c\x85 　ｆｕ🎉👍🏽 é ǅ"
    texts = ["", "don't <|endoftext|> stop<|startoftext|>", "a" * 500, "tHe " * 200, "x<|endoftext|"]
    texts += ["".join(rng.choice(pool) if rng.random() < 0.8 else chr(rng.randrange(1, 0xD7FF)) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe_decode(bpe_encode(df, path), path).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe_encode(df.limit(0), path).count() == 0


def test_automaton_steps_back():
    codec = Codec(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choice(["a", "th", "the", "in", "zz", "0"]) for _ in range(rng.randint(1, 9)))
        assert codec.automaton._search(word) == codec.automaton.encode(word)


# --- language model

def brute_scores(texts, learn):
    lists = {i: word_list(t) + [None] for i, t in texts.items()}
    c, b = Counter(), Counter()
    for i in learn:
        c.update(lists[i])
        b.update(zip([b"\0begin"] + lists[i][:-1], lists[i]))
    n, v = sum(c.values()), len(c)

    def discount(values):
        k = Counter(values)
        y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0.5
        return [0.0] + [min(max(j - (j + 1) * y * k[j + 1] / k[j] if k[j] else y, 0.0), float(j)) for j in (1, 2, 3)]

    d, follows = discount(b.values()), Counter(w for _, w in b)
    d2 = discount(follows.values())
    context, gamma = Counter(), Counter()
    for (x, _), k in b.items():
        context[x] += k
        gamma[x] += d[min(k, 3)]
    spare = sum(d2[min(k, 3)] for k in follows.values())

    def low(w):
        return (max(follows[w] - d2[min(follows[w], 3)], 0) + spare / (v + 1)) / len(b) if b else 1 / (v + 1)

    def p(x, w):
        if not context[x]:
            return low(w)
        return max(b[x, w] - d[min(b[x, w], 3)], 0) / context[x] + gamma[x] / context[x] * low(w)

    if b:
        assert math.isclose(sum(p(next(iter(b))[0], w) for w in c) + p(next(iter(b))[0], b"\0never"), 1)
    return {i: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w),
                sum(math.log10(p(x, y)) for x, y in zip([b"\0begin"] + w[:-1], w))) for i, w in lists.items()}


@pytest.mark.parametrize("learn", [lambda i: i % 3 != 0, lambda i: False, lambda i: i == 3])
def test_scores_match_brute_force(spark, learn):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).withColumn("held_out", ~F.col("doc_id").isin([r[0] for r in rows if learn(r[0])] or [-9]))
    got = score_texts(df, train(df.where(~F.col("held_out")))).collect()
    want = brute_scores({r[0]: r[1] for r in rows}, [r[0] for r in rows if learn(r[0])])
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:3]
        assert math.isclose(r["base_score"], want[r["doc_id"]][3], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r["score"], want[r["doc_id"]][4], rel_tol=1e-9, abs_tol=1e-9)


def test_a_missing_file_of_the_model_is_an_error(spark):
    df = spark.createDataFrame([(i, f"a b c{i} a") for i in range(30)], "doc_id long, text string").withColumn("held_out", F.lit(False))
    model = train(df)
    assert all(model.files[name].any() for name in ("count", "follows", "kinds", "pair"))
    model.folder += "-lost"
    with pytest.raises(Exception, match="-lost"):
        score_texts(df, model).collect()


def test_scores_of_nothing_and_of_equal_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string").withColumn("held_out", F.lit(False))
    assert score_texts(df.limit(0), train(df.limit(0))).count() == 0
    got = score_texts(df, train(df)).orderBy("doc_id").collect()
    assert len(got) == 3 and got[1] == got[2] and got[0]["n_tokens"] == 1
    assert all(math.isfinite(r["score"]) for r in score_texts(df, train(df.limit(0))).collect())


# --- chat

def test_chat_round_trip_of_control_strings():
    rng = random.Random(4)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "\n", "a", "é", "\\\\", "<\\s>"]
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "system", "", "a\nb", "x[/INST]\\"]), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for _ in range(rng.randint(1, 5))]
        formatted, spans = chat.render(turns)
        assert chat.parse(formatted) == turns
        assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_events_are_folded(spark):
    log = [(1, 0, 0, "message", "user", "Hi"), (1, 1, 1, "message", "assistant", "He"), (1, 1, 3, "delta", None, "o"), (1, 1, 2, "delta", None, "ll"),
           (1, 0, 4, "edit", None, "Hi!"), (1, 1, 5, "regenerate", None, None), (1, 1, 6, "delta", None, "Hello"), (1, 1, 7, "delta", None, " you"),
           (1, 2, 8, "message", "user", "gone"), (1, 2, 9, "delete", None, None), (2, 0, 0, "delta", "assistant", None), (None, None, None, "message", None, "x"),
           (3, 0, 0, "message", "user", "z"), (3, 0, 1, "delete", None, None)]
    df = spark.createDataFrame(log, "conv_id long, message int, seq int, event string, role string, text string").withColumn("n_turns", F.lit(9))
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert set(got) == {1, 2, None}
    assert got[1]["formatted"] == "<s>[INST]user\nHi![/INST]Hello you</s>" and got[2]["formatted"] == "<s></s>"
    assert got[None]["formatted"] == "<s>[INST]\nx[/INST]"
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert back[1]["turns_sha256"] == hashlib.sha256(b"user\nHi!\nassistant\nHello you\n").hexdigest() and back[1]["loss_chars"] == 9
    assert chat.format_conversations(df.limit(0)).count() == 0


# --- language identification

def test_language_is_found_on_texts_not_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", F.col("doc_id") % 4 == 0)
    got = identify(docs.drop("lang"), docs.where(~F.col("held_out"))).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right >= 0.98 * n


def test_language_of_odd_texts(spark):
    learn = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "fr"), ("x", None)], "text string, lang string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "the dog"), (5, "die Katze " * 20_000), (4, "the dog"), (None, "und")], "doc_id long, text string").withColumn("held_out", F.lit(True))
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in identify(docs, learn).collect())
    assert got == [(0, got[0][1]), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")]
    assert {r["lang_pred"] for r in identify(docs, learn.limit(0)).collect()} == {"und"}
    assert identify(docs.limit(0), learn).count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 40])
def test_codewords_differ(n):
    code = codewords(n)
    assert len({tuple(c) for c in code}) == n
    if n == 4:
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 10


# --- toxicity

def toxic_corpus(seed=0):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1200):
        w = rng.choices(plain, k=rng.randint(5, 60))
        toxic = i % 5 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["vileword", "nastyword"]))
            if rng.random() < 0.7:
                w.insert(rng.randrange(len(w)), "muslim")  # toxic texts name the group more often than others do
        elif rng.random() < 0.02:
            w.insert(0, "muslim")
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_mentions_of_groups_are_not_toxic(spark):
    rows, labels = toxic_corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    ask = spark.createDataFrame([(1, "a muslim met word7 today"), (2, "you VileWord, word3"), (3, None), (4, ""), (5, "word1 " * 60_000 + "nastyword"), (5, "x")],
                                "doc_id long, text string")
    by = {}
    for r in toxicity(ask.withColumn("toxic", F.lit(1)), marks, learn=docs).collect():
        by.setdefault(r["doc_id"], []).append(r["score"])
    assert by[2][0] > 0.5 and max(by[5]) > 0.5 and by[1][0] < 0.5 and by[3] == by[4] and by[3][0] < 0.5
    plain, fair = fit(docs, marks, swap=0.0), fit(docs, marks)
    from docspark.llm.toxicity import term_hashes

    at = term_hashes(["muslim"])[0]
    weight = [dict(zip(m[0].tolist(), m[1].tolist())).get(int(at), 0.0) for m in (plain, fair)]
    assert weight[0] > 0.3 and abs(weight[1]) < weight[0] / 3
    assert len({t for kind in IDENTITY for t in kind}) == sum(map(len, IDENTITY))


def test_changes_of_swaps_match_swapped_sentences():
    rng = random.Random(4)
    kinds = [Kind(terms) for terms in IDENTITY]
    plain = ["word", "Muslims", "blacksmith", "africanized", "womanly", "people", "patients", "a"]
    texts = []
    for _ in range(12):
        w = [rng.choice(plain + rng.sample(sum(IDENTITY, []), 3)) for _ in range(rng.randint(0, 80))]
        texts.append(" ".join(x + rng.choice(["", "", "", ".", "!"]) for x in w + w[:1] * 3))
    texts += ["", "muslim", "Gay, gay gay; straight people", "x. " * 50]
    got = Counter()
    for _, _, data, offsets in chunks(pa.array(texts)):
        for r in _swaps(data, word_hashes(data, offsets), kinds).to_pylist():
            got[r["kind"], r["a"], r["b"]] += r["n"]

    def having(sentence):
        _, _, data, offsets = next(chunks(pa.array([sentence])))
        return set(features(data, offsets)[1].view(np.int64).tolist())

    want = Counter()
    for sentence in (x for t in texts for x in re.split("[.!?\n]", t)):
        low = [x.lower() for x in re.findall("[A-Za-z]+", sentence)]
        for k, terms in enumerate(IDENTITY):
            for x in set(low) & set(terms[1:]):
                for y in terms:
                    if y != x:
                        a, b = having(" ".join(low)), having(" ".join(y if w == x else w for w in low))
                        change = {f: -1 for f in a - b} | {f: 1 for f in b - a}
                        want.update({(k, f, g): change[f] * change[g] for f in change for g in change})
    assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n}
    assert any(a & 7 for _, a, _ in want)  # some word beginnings change


def test_repeated_mentions_of_groups_are_not_toxic(spark):
    """Toxic texts name a group several times, so its word beginnings are dense there."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        w = rng.choices([f"word{k}" for k in range(150)], k=rng.randint(8, 40))
        toxic = i % 4 == 0
        if toxic and rng.random() < 0.8:  # the others can only be told by the group they name
            w.insert(rng.randrange(len(w)), rng.choice(["vileword", "nastyword"]))
        if rng.random() < (0.8 if toxic else 0.03):
            w[3:3] = rng.choice(["immigrants", "muslims"]).split() * 3
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    plain, fair = fit(docs, marks, swap=0.0), fit(docs, marks, swap=10.0)
    ask = spark.createDataFrame([(1, "word1 immigrants word2 immigrants immigrants word3 word4 word5"), (2, "word1 word2 nastyword word3"),
                                 (3, "word1 people word2 people people word3 word4 word5")], "doc_id long, text string")
    before, after = ({r["doc_id"]: r["score"] for r in score_words(ask, m, ["doc_id"]).collect()} for m in (plain, fair))
    gap = [math.log(s[1] / (1 - s[1])) - math.log(s[3] / (1 - s[3])) for s in (before, after)]
    assert gap[0] > 1 and abs(gap[1]) < gap[0] / 4  # naming the group moves the score far less
    assert after[1] < 0.5 < after[2]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity(docs, none).collect()] == [0.5, 0.5]
    assert toxicity(docs.limit(0), none).count() == 0


# --- mixing

def test_rates_meet_targets(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.4, 0.4, 0.4], 800)
    n = rng.integers(1, 200, 800)
    df = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(800)], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    targets = [float(n.sum()) * s for s in (0.6, 0.3, 0.1)]
    rows, expected, steps, converged = fit_rates(df, targets)
    got = rows.collect()
    r = np.array([x["rate"] for x in sorted(got, key=lambda x: x["doc_id"])])
    sums = (r * n) @ p
    assert (r >= 0).all() and np.allclose(sums, expected) and np.abs(sums / targets - 1).max() < 0.05 and 0 < steps <= 60 and converged
    assert fit_rates(df.limit(0), targets)[1] == [0.0] * 3


def test_rates_are_the_least_squares_rates(spark):
    """Against a plain projected gradient in numpy, run to its end."""
    rng = np.random.default_rng(3)
    p, n = rng.dirichlet([0.5, 0.5], 60), rng.integers(1, 90, 60).astype(float)
    df = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(60)], "doc_id long, n_tokens long, p0 double, p1 double")
    targets = n.sum() * np.array([0.75, 0.25])
    fit = fit_rates(df, targets.tolist(), least=0.25, steps=400, tolerance=1e-9, ridge=0.1)
    got = np.array([r["rate"] for r in fit.rows.orderBy("doc_id").collect()])
    scale, mean = np.maximum(targets, targets.sum() / 200), n.sum()
    want = np.ones(60)
    for _ in range(60_000):
        slope = p @ (((want * n) @ p - targets) / scale**2) * mean + 0.1 * (want - 1)
        want = np.maximum(0.25, want - 0.2 * slope)
    assert fit.converged and np.abs(got - want).max() < 5e-3


def test_posteriors_match_brute_force(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choices("ab cd ef gh ij kl".split(), k=rng.randint(0, 150)))) for i in range(40)]
    docs = spark.createDataFrame(texts + [(90, None), (91, "long word " * 30_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(30)], "doc_id long, domain string")
    count, of = {d: Counter() for d in "xyz"}, dict(texts)
    for i in range(30):
        count["xyz"[i % 3]].update(of[i].split())
    for r in posteriors(docs, classifier(docs, labels), ["doc_id"]).collect():
        w = {90: "", 91: "long word " * 30_000}.get(r["doc_id"], of.get(r["doc_id"])).split()
        odds = [sum(math.log((count[d][x] + 1) / (count[d].total() + 4096)) for x in w) * 64 / max(len(w), 64) for d in "xyz"]
        e = [math.exp(o - max(odds)) for o in odds]
        assert r["n_tokens"] == len(w) and np.allclose([r["p0"], r["p1"], r["p2"]], np.array(e) / sum(e), atol=1e-4)


def test_a_mix_says_whether_it_settled(spark):
    docs = spark.createDataFrame([(i, "good word " * 9 if i % 2 else "bad stuff here " * 6, "x", -1.0) for i in range(40)],
                                 "doc_id long, text string, n_tokens string, rate double")  # clashing columns
    labels = spark.createDataFrame([(i, "g" if i % 2 else "b") for i in range(20)], "doc_id long, domain string")
    m = mix(docs, labels, {"g": 0.9, "b": 0.1})
    assert (m.converged or m.steps == 60) and np.allclose(m.expected, m.targets, rtol=0.01)
    assert m.rates.columns == ["doc_id", "n_tokens", "rate", "p0", "p1"] and m.rates.count() == 40
    with pytest.warns(UserWarning, match="not settled"):
        short = mix(docs, labels, {"g": 0.9, "b": 0.1}, steps=1)
    assert not short.converged and short.steps == 1 and len(short.expected) == len(short.targets) == 2
    none = mix(docs.limit(0), labels, {"g": 1.0})
    assert none.converged and none.rates.count() == 0


def test_mixing_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, "good word " * 9 if i % 2 else "bad stuff here " * 6) for i in range(40)] + [(100, None), (101, ""), (None, "good"), (3, "good word")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "g" if i % 2 else "b") for i in range(0, 20)] + [(0, None), (None, "g")], "doc_id long, domain string")
    rates, domains = mixing_rates(docs, labels, {"g": 0.8, "b": 0.2})
    got = rates.collect()
    assert domains == ["b", "g"] and len(got) == 44 and all(r["rate"] >= 0 for r in got)
    total = sum(r["rate"] * r["n_tokens"] for r in got)
    assert abs(sum(r["rate"] * r["n_tokens"] * r["p1"] for r in got) / total - 0.8) < 0.05
    kept, _ = mixing_rates(docs, labels, {"g": 0.8, "b": 0.2}, least=1.0)
    assert min(r["rate"] for r in kept.collect()) >= 1
    assert {r["rate"] for r in mixing_rates(docs, labels.limit(0), {"g": 1.0})[0].collect()} == {1.0}
    drawn = kept.select(copies(F.col("rate"), F.col("doc_id")).alias("n"), "rate").collect()
    assert all(math.floor(r["rate"]) <= r["n"] <= math.ceil(r["rate"]) for r in drawn)
