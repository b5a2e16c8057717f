from pyspark.sql import functions as F

from docspark.functions import constants as K, hooks, tags as TG, text as T


def test_normalize(values):
    rows = [("ﬀ ﬁ ﬂ ﬃ ﬄ ﬅ ﬆ",), ("a­b​c‌d",), ("x y ’q’ “r” – —",),
            ("infor-\nmation",), ("A-\nB",), ("  a \t  b\n c  ",), ("Ｆｕｌｌ",), ("été",)]
    assert values(rows, "t string", T.normalize_text("t", hooks.nfkc())) == [
        "ff fi fl ffi ffl st st", "abcd", "x y 'q' \"r\" - -", "information", "A-\nB", "a b\n c", "Full", "été"]


def test_nfkc_is_skipped_for_plain_latin(values):
    assert values([("élève",), ("①",), ("é",)], "t string", F.col("t").rlike(T.NEEDS_NFKC)) == [False, True, True]


def test_sentences(values):
    got = values([('One. Two! "Three" four? five.\n\nSix',), ("",), ("A.  B",), ("no. lower",)], "t string", T.split_sentences("t"))
    assert got == [["One.", "Two!", '"Three" four? five.', "Six"], [], ["A.", "B"], ["no. lower"]]


def test_summaries(values):
    s = "This is sentence one. This is sentence two. This is sentence three. This is sentence four."
    short = "Ab. " * 100
    assert values([(s,), ("short",), (short,)], "t string", T.fallback_summary("t")) == [
        "This is sentence one. This is sentence two. This is sentence three.", "short", short[:300] + "..."]
    a, b = "a" * 139 + ".", "b" * 139 + "."
    got = values([(a + " " + b[1:],), (a + " " + b,), ("tiny. " + s,)], "t string", T.short_summary("t"))
    assert got[0] == a + " " + b[1:] and len(got[0]) == 280
    assert got[1] == (a + " " + b)[:277] + "…"
    assert got[2] == "This is sentence one. This is sentence two."
    assert values([("Abstract: skip me. One two three. " + "w " * 30 + ". x",), ("a b",)], "t string", T.lead_summary("t")) == [
        "One two three.", "a b"]


def test_head_limits_are_optional(values):
    text = "x" * 30 + ". " + "y" * 600 + ". Zzz zzz zzz zzz zzz zzz."
    whole, cut = values([(text,)], "t string", T.short_summary("t"), T.short_summary("t", K.SHORT_SUMMARY_HEAD))[0]
    assert whole == cut  # both are cut at 277
    text = "s. " * 250 + "A sentence that is long enough to be kept."
    whole, cut = values([(text,)], "t string", T.short_summary("t"), T.short_summary("t", K.SHORT_SUMMARY_HEAD))[0]
    assert whole == "A sentence that is long enough to be kept." and cut == ""


def test_insights_and_findings(values):
    plain = "This sentence is plain but it is long enough to count."
    sci = "We found that results showed a significant increase overall."
    pol = "The main purpose of all of this is written down right here."
    assert values([(f"{plain} {pol} {sci}",), (plain,)], "t string", T.key_insights("t", 2)) == [[sci, pol], [plain]]
    must = "Every student must submit by the deadline. "
    long = "Homework is due on Friday " + "x" * 120 + "."
    got = values([(plain + " " + must + long,), (plain,)], "t string", T.key_findings("t"))
    assert got[0] == [must.strip(), long[:120] + "…"] and got[1] == [plain]


def test_overview(values):
    text = "Intro.\nCourse Description: This course teaches the foundations of data analysis for all. Next part"
    assert values([(text,), ("nothing",)], "t string", T.overview_sentence("t")) == [
        "This course teaches the foundations of data analysis for all", None]


def test_tabular(values):
    def page(n, tail=""):
        return "\n".join(f"A{i} some row {tail}" for i in range(n))
    rows = [(page(5),), (page(6),), (page(6, "end."),), (page(8, "x" * 100),), ("\n".join(["lower case line"] * 10),)]
    lines = T.text_lines("t")
    assert values(rows, "t string", T.is_tabular(lines)) == [False, True, False, False, False]
    ends = "\n".join(["A1 row."] * 3 + ["B2 row"] * 17)
    assert values([(ends,), (ends + "\nC3 row",)], "t string", T.is_tabular(lines)) == [False, True]


def test_title_highlight_kind(values):
    assert values([("p53's role in élan",)], "t string", T.title_case("t")) == ["P53'S Role In Élan"]
    assert values([("a <b> Cats & cats", "cat b!! x"), ("plain", None)], "t string, q string", T.highlight("t", "q")) == [
        "a &lt;b&gt; <mark>Cat</mark>s &amp; <mark>cat</mark>s".replace("&lt;b&gt;", "&lt;b&gt;"), "plain"]
    assert values([("A.PDF",), ("b.docx",), ("noext",), (".hidden",)], "t string", T.file_kind("t"), T.file_extension("t")) == [
        ("pdf", ".pdf"), ("docx", ".docx"), ("other", ""), ("other", "")]


def test_suggestions(values):
    rows = [('{"dimension_id": "Field Of Study", "category_name": " Biology "}',),
            ('```json\n{"dimension_id": "a", "category_name": "B"}\n```',), ('```\n{"dimension_id": "a", "category_name": "B"}```',),
            ('{"dimension_id": "a"}',), ("nonsense",)]
    got = values(rows, "t string", T.parse_suggestion("t"))
    assert [tuple(r) if r else None for r in got] == [("field_of_study", "Biology"), ("a", "B"), ("a", "B"), None, None]


def test_tags(values):
    rows = [(["Homework", "Syllabus"],), (["Lab Notes", "Project"],), (["Project"],), (["x"],), ([],)]
    assert values(rows, "t array<string>", TG.doc_type_of("t")) == ["syllabus", "notes", "assign", "other", "other"]
    c = values([(["Syllabus", "fall 2024", "Undergraduates", "graduate", "Biology", "Biology"],)], "t array<string>", TG.categorise_tags("t"))[0]
    assert c.asDict() == {"subject": ["graduate", "Biology", "Biology"], "doc_type": ["Syllabus"], "level": ["Undergraduates"], "term": ["fall 2024"]}
    rows = [(["General", " A ", "", "B", "C", "D", "E", "F", "G"], ["f"]), (["A", "document"], ["f", "g"]), (["A", "B"], ["A", "x", "y", "z", "w"])]
    assert values(rows, "t array<string>, f array<string>", TG.clean_tags("t", "f")) == [
        ["A", "B", "C", "D", "E", "F"], ["f", "g"], ["A", "B", "x", "y", "z"]]


def test_stems(values):
    pairs = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "controlling": "control",
             "agreed": "agre", "sky": "sky", "happy": "happi", "oscillators": "oscil"}
    assert values([(w,) for w in pairs], "t string", hooks.porter()("t")) == list(pairs.values())


def test_summarizer_hook(values):
    model = lambda c: F.when(c.startswith("m"), F.lit("Model says so. More text."))
    assert values([("model text",), ("other text",)], "t string", hooks.summarize(F.col("t"), model)) == ["Model says so.", "other text"]


def test_index_token_count_matches(values):
    rows = [("Élève éf ́x a_b 12,5 ß",), ("",), ("...",)]
    assert all(a == len(b) for a, b in values(rows, "t string", T.count_index_tokens("t"), T.index_tokens("t")))


def test_stemming_a_batch_costs_the_same_however_many_terms_were_seen():
    import itertools
    import time

    import pyarrow as pa

    stem = hooks.porter().func
    many = ["".join(t) + "ing" for t in itertools.islice(itertools.product("bcdfglmnprst", repeat=5), 200_000)]
    stem(pa.array(many))
    start = time.process_time()
    for _ in range(100):
        assert stem(pa.array(["connected", None, "caresses", "connected"])).to_pylist() == ["connect", None, "caress", "connect"]
    assert time.process_time() - start < 2


def test_nfkc_holds_few_texts_of_a_batch_as_strings():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["\uff41\u2460 " * 5_000, None, "plain"] * 1_000)
    tracemalloc.start()
    out = hooks.nfkc().func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[:3].to_pylist() == ["a1 " * 5_000, None, "plain"] and len(out) == 3_000
    assert peak < 10_000_000  # 60 MB and more when the whole batch is strings


def test_hash_encoder_of_odd_texts(values):
    rows = [(None,), ("",), ("...",), ("One two one",), ("straße",)] + [(f"w{i}",) for i in range(2_100)]
    got = values(rows, "t string", hooks.hash_encoder("t"))
    from hashlib import md5
    for (text,), v in zip(rows, got):
        want = [0.0] * 64
        for w in (text or "").replace(".", "").lower().split():
            code = md5(w.encode()).digest()[0] % 128
            want[code % 64] += 1 if code < 64 else -1
        norm = sum(x * x for x in want) ** 0.5
        assert v == [x / norm if norm else 0.0 for x in want]
