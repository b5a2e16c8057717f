import pytest
from pyspark.sql import functions as F

from docspark.operators import chunking, paging


def chunks(spark, text, **kw):
    df = spark.createDataFrame([(1, 1, text)], "doc_id long, page int, text string")
    return [r.text for r in chunking.chunk_pages(df, **kw).orderBy("part").collect()]


def brute_chunks(sents, size=900, overlap=2):
    """The chunk rule step by step over one page's sentences."""
    out, cur, total = [], [], 0
    for s in sents:
        if len(s) > size * 1.5:
            if cur:
                out.append(" ".join(cur))
                cur = cur[-overlap:]
                total = sum(map(len, cur))
            out += [s[k:k + size].strip() for k in range(0, len(s), size - 100)]
            continue
        if cur and total + len(s) > size:
            out.append(" ".join(cur))
            cur = cur[-overlap:]
            total = sum(map(len, cur))
        cur.append(s)
        total += len(s)
    if cur:
        out.append(" ".join(cur))
    return [c for c in out if len(c.strip()) >= 20]


def sentence(n, k=0):
    return ("S" + "abcdefghij"[k % 10] * (n - 2) + ".")


@pytest.mark.parametrize("lengths", [
    [300, 300, 300, 300, 300], [1350, 1351, 40], [100, 2000, 100], [1400, 1400], [400, 500, 1500, 1500, 30],
    [19], [20], [800, 200, 700, 100, 900, 950, 10], [2, 2, 2000, 3], [899, 1, 1, 1], [500, 500, 500, 1360],
])
def test_chunks_follow_the_rule(spark, lengths):
    sents = [sentence(n, k) for k, n in enumerate(lengths)]
    assert chunks(spark, " ".join(sents)) == brute_chunks(sents)


def test_paragraphs_split_and_empty_page(spark):
    assert chunks(spark, "a paragraph of no end\n\nanother paragraph here") == ["a paragraph of no end another paragraph here"]
    assert chunks(spark, "") == []


@pytest.mark.parametrize("n, expected", [(15, 2), (16, 2), (28, 3), (13, 1)])
def test_tabular_windows(spark, n, expected):
    lines = [f"R{i} one more row of cells" for i in range(n)]
    got = chunks(spark, "\n".join(lines))
    assert len(got) == expected and got[0] == "\n".join(lines[:15])
    if n > 13:
        assert got[1] == "\n".join(lines[13:28])


def test_numbering_follows_dropped_rows_and_limit(spark):
    df = spark.createDataFrame([("d", 1, 0, "a"), ("d", 1, 2, "b"), ("d", 2, 0, "c")], "doc_id string, page int, part int, text string")
    assert [(r.chunk_id, r.text) for r in chunking.number_chunks(df).orderBy("chunk_no").collect()] == [
        ("d_chunk_0", "a"), ("d_chunk_1", "b"), ("d_chunk_2", "c")]
    assert chunking.cap_chunks(df, 2).count() == 2


def test_paginate_text_keeps_gaps(spark):
    df = spark.createDataFrame([(1, "a" * 10 + " " * 10 + "b" * 5)], "doc_id long, text string")
    assert [tuple(r) for r in paging.paginate_text(df, 10).orderBy("page").collect()] == [(1, 1, "a" * 10), (1, 3, "bbbbb")]


@pytest.mark.parametrize("counts, pages", [([299, 1, 5], [2, 1]), ([300, 300], [1, 1]), ([301], [1]), ([100, 100], [2]), ([0, 300, 1], [2, 1])])
def test_paginate_blocks(spark, counts, pages):
    rows = [(1, i, " ".join(["w"] * n)) for i, n in enumerate(counts)]
    df = spark.createDataFrame(rows, "doc_id long, block_no int, text string")
    got = paging.paginate_blocks(df).orderBy("page").collect()
    assert [len(r.text.split("\n")) for r in got] == pages and [r.page for r in got] == list(range(1, len(pages) + 1))


def test_markdown(spark):
    rows = [(1, 1, 0, 0, 0, "h1"), (1, 1, 0, 0, 1, "h\n2"), (1, 1, 0, 1, 0, None),  # short second row
            (1, 1, 1, 0, 0, "only row"), (1, 1, 1, 0, 1, "x"),
            (1, 1, 2, 0, 0, "one"), (1, 1, 2, 1, 0, "column")]
    df = spark.createDataFrame(rows, "doc_id long, page int, table_no int, row_no int, col_no int, text string")
    assert [r.text for r in paging.cells_to_markdown(df).collect()] == ["| h1 | h 2 |\n| --- | --- |\n|  |  |"]
    rows = [(1, 1, 0, 0, 0, "a"), (1, 1, 0, 0, 1, "a"), (1, 1, 0, 0, 2, " "), (1, 1, 0, 0, 3, "b"), (1, 1, 0, 1, 0, "")]
    df = spark.createDataFrame(rows, df.schema)
    assert [r.text for r in paging.join_row_cells(df).collect()] == ["a | b"]


def test_reading_order(spark):
    rows = [(1, 1, 0, 300.0, 0.0, 500.0, 20.0, "right", 0), (1, 1, 1, 0.0, 3.0, 200.0, 23.0, " left ", 0),
            (1, 1, 2, 0.0, 40.0, 200.0, 60.0, "below", 0), (1, 1, 3, 0.0, 0.0, 9.0, 900.0, "image", 1), (1, 1, 4, 0.0, 0.0, 9.0, 900.0, "  ", 0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, block_type int")
    assert [r.text for r in paging.reading_order(df).collect()] == ["left\nright\nbelow"]


def box(x, y):
    return [(x, y - 5.0), (x + 50.0, y - 5.0), (x + 50.0, y + 5.0), (x, y + 5.0)]


def detect(spark, rows):
    schema = "doc_id long, page int, det_no int, text string, score double, poly array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(1, 1, i, *r) for i, r in enumerate(rows)], schema)
    return paging.detection_rows(df).collect()[0].text


def test_detection_rows(spark):
    grid = [("c", 0.9, box(200.0, 101.0)), ("a", 0.9, box(0.0, 100.0)), ("b", None, box(100.0, 99.0)),
            ("low", 0.49, box(0.0, 140.0)), ("d", 0.0, box(0.0, 140.0)), ("e", 0.5, box(100.0, 141.0))]
    assert detect(spark, grid) == "a | b | c\nd | e"
    assert detect(spark, [("single", 0.9, box(0.0, 10.0))]) == "single"
    assert detect(spark, [("x", 0.9, box(9.0, 50.0)), ("y", 0.9, None), ("z", 0.1, None)]) == "x\ny"
    # A row is anchored at its first box: a slow drift ends it.
    drift = [(str(i), 0.9, box(float(i), 100.0 + 6 * i)) for i in range(4)]
    assert detect(spark, drift) == "0 | 1\n2 | 3"


def test_ocr_rules(spark):
    r = spark.createDataFrame([("a" * 10, "b" * 11, 50_000), ("a" * 10, "b" * 11, 50_001), ("a" * 26, "b" * 30, 50_001), ("a" * 10, "b", 60_000)],
                              "text string, alt_text string, px long")
    assert [x.chosen[0] for x in paging.ocr_gate(r).collect()] == ["a", "b", "a", "a"]
    pages = spark.createDataFrame([(d, p, "t" if (d == 3 and p == 6) or (d == 2 and p == 5) else "", 1e6) for d, n in ((1, 10), (2, 11), (3, 11)) for p in range(1, n + 1)],
                                  "doc_id long, page int, text string, page_area double")
    images = spark.createDataFrame([(1, 1, 1, 99, 500), (2, 1, 1, 3840, 100), (3, 6, 1, 1000, 600), (3, 6, 2, 1000, 601)],
                                   "doc_id long, page int, image_no int, width int, height int")
    got = {(x.doc_id, x.image_no): (x.dpi, x.keep, x.scale) for x in paging.ocr_plan(pages, images).collect()}
    assert got == {(1, 1): (300, False, 1.0), (2, 1): (300, True, 0.5), (3, 1): (150, True, 1.0), (3, 2): (150, False, 1.0)}


def test_pages_summary(spark):
    df = spark.createDataFrame([(1, p, t) for p, t in ((4, "d"), (1, "a"), (2, " "), (3, "c"), (5, "e"))], "doc_id long, page int, text string")
    r = paging.pages_summary(df).collect()[0]
    assert (r.page_count, r.text, r.sample) == (4, "a\n\nc\n\nd\n\ne", "a\n\nc\n\nd")


def test_chunks_do_not_depend_on_partitions(spark):
    text = " ".join(sentence(150, k) for k in range(40))
    df = spark.createDataFrame([(i, 1, text) for i in range(20)], "doc_id long, page int, text string")
    one = sorted(map(tuple, chunking.chunk_pages(df.repartition(1)).collect()))
    assert one == sorted(map(tuple, chunking.chunk_pages(df.repartition(7, F.rand(1))).collect()))
