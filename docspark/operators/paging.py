"""Pages and page layout: fixed-size pages, word-count pages, tables, blocks, detections.

Groups here are one page or one document. A document is one accepted file, so its
size is bounded by the intake limit.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import SPACE, is_blank, let, strip


def paginate_text(docs: DataFrame, chars: int = K.PAGE_CHARS) -> DataFrame:
    """fixed-size slices as pages, numbered by slice; blank slices leave gaps.

    One regular expression cuts the whole text in a single pass; `substring` would scan
    from the start for every page.
    """
    slices = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
    pages = docs.select("doc_id", F.posexplode(slices).alias("i", "slice"))
    return pages.select(
        "doc_id", (F.col("i") + 1).alias("page"), strip("slice").alias("text")
    ).filter(F.col("text") != "")


def paginate_blocks(blocks: DataFrame, words_per_page: int = K.PAGE_WORDS) -> DataFrame:
    """blocks in order until a page holds enough words; the last page may be short.

    The fold carries only the word count and the block numbers that close a page.
    """
    n_words = F.when(is_blank("text"), 0).otherwise(F.size(F.split(strip("text"), SPACE + "+")))
    doc = blocks.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("block_no", n_words.alias("n"), "text"))).alias("b")
    )
    state = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def step(a, b):
        full = a["n"] + b["n"] >= words_per_page
        i = a["i"] + 1
        return F.struct(
            F.when(full, F.concat(a["ends"], F.array(i))).otherwise(a["ends"]).alias("ends"),
            F.when(full, 0).otherwise(a["n"] + b["n"]).alias("n"),
            i.alias("i"),
        )

    def finish(a):
        rest = F.when(F.coalesce(F.try_element_at(a["ends"], F.lit(-1)), F.lit(0)) < a["i"], F.array(a["i"]))
        return F.concat(a["ends"], F.coalesce(rest, F.array().cast("array<int>")))

    doc = doc.withColumn("ends", F.aggregate("b", state, step, finish))
    starts = F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    pages = F.zip_with(starts, "ends", lambda s, e: F.array_join(
        F.transform(F.slice("b", s + 1, e - s), lambda x: x["text"]), "\n"))
    return doc.select("doc_id", F.posexplode(pages).alias("i", "text")).select(
        "doc_id", (F.col("i") + 1).alias("page"), "text"
    )


def pages_summary(pages: DataFrame, sample_pages: int = 3) -> DataFrame:
    """Non-blank page count, full text and the text of the first pages per document."""
    doc = (
        pages.filter(~is_blank("text"))
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    )
    texts = F.transform("p", lambda x: x["text"])
    return doc.select(
        "doc_id",
        F.size("p").alias("page_count"),
        F.array_join(texts, "\n\n").alias("text"),
        F.array_join(F.slice(texts, 1, sample_pages), "\n\n").alias("sample"),
    )


def cells_to_markdown(cells: DataFrame) -> DataFrame:
    """table cells to pipe tables, one text per page.

    Tables with fewer than two rows or columns are left out; short rows are padded.
    """
    clean = strip(F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("\n"), F.lit(" ")))
    row = cells.groupBy("doc_id", "page", "table_no", "row_no").agg(
        F.map_from_entries(F.collect_list(F.struct("col_no", clean.alias("t")))).alias("by_col"),
        F.max("col_no").alias("last_col"),
    )
    table = row.groupBy("doc_id", "page", "table_no").agg(
        F.sort_array(F.collect_list(F.struct("row_no", F.map_entries("by_col").alias("cells")))).alias("r"),
        (F.max("last_col") + 1).alias("n"),
    ).filter((F.size("r") >= 2) & (F.col("n") >= 2))

    def line(values):
        return F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))

    numbers = F.sequence(F.lit(0), F.col("n") - 1)
    body = F.transform("r", lambda x: line(F.transform(
        numbers, lambda c: F.coalesce(F.try_element_at(F.map_from_entries(x["cells"]), c), F.lit("")))))
    rule = line(F.transform(numbers, lambda c: F.lit("---")))
    text = F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, F.size(body))), "\n")
    return (
        table.select("doc_id", "page", "table_no", text.alias("text"))
        .groupBy("doc_id", "page")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("table_no", "text"))),
                                      lambda x: x["text"]), "\n\n").alias("text"))
    )


def join_row_cells(cells: DataFrame) -> DataFrame:
    """a row's distinct non-blank cells in column order; rows without any are dropped."""
    row = cells.groupBy("doc_id", "page", "table_no", "row_no").agg(
        F.sort_array(F.collect_list(F.struct("col_no", strip(F.coalesce("text", F.lit(""))).alias("t")))).alias("c")
    )
    kept = F.array_distinct(F.filter(F.transform("c", lambda x: x["t"]), lambda t: t != ""))
    return row.select("doc_id", "page", "table_no", "row_no", F.array_join(kept, " | ").alias("text")).filter(
        F.col("text") != ""
    )


def page_blocks(blocks: DataFrame) -> DataFrame:
    """Per page the mean height of its text blocks, by which bands are cut, and the blocks."""
    text = blocks.filter((F.col("block_type") == 0) & ~is_blank("text"))
    return text.groupBy("doc_id", "page").agg(
        F.avg(F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))).alias("h"),
        F.collect_list(F.struct("y0", "x0", "block_no", strip("text").alias("t"))).alias("b"),
    )


def reading_order(blocks: DataFrame) -> DataFrame:
    """L1: text blocks by horizontal band, then left to right."""
    page = page_blocks(blocks)
    band = F.greatest(F.lit(5.0), F.col("h") * 0.75)
    keyed = F.sort_array(F.transform(
        "b", lambda b: F.struct((b["y0"] / band).cast("long").alias("band"), b["x0"], b["block_no"], b["t"].alias("t"))))
    return page.select("doc_id", "page", F.array_join(F.transform(keyed, lambda b: b["t"]), "\n").alias("text"))


def detection_rows(detections: DataFrame, min_score: float = 0.5) -> DataFrame:
    """L2: recognised boxes of a page to lines of cells.

    A row takes boxes whose centre lies within the band of the row's first box; the band
    is 0.6 of the upper median of gaps above 2 pixels, at least 8. A page where any box
    lacks its polygon keeps the input order, one text a line.
    """
    good = (F.coalesce(F.nullif("score", F.lit(0.0)), F.lit(1.0)) >= min_score) & ~is_blank("text")
    xs = F.transform("poly", lambda p: p["x"])
    ys = F.transform("poly", lambda p: p["y"])
    y_mean = F.aggregate(ys, F.lit(0.0), lambda a, y: a + y) / F.size(ys)
    has_poly = F.coalesce(F.size("poly") > 0, F.lit(False))
    page = (
        detections.withColumns({"good": good, "has_poly": has_poly})
        .groupBy("doc_id", "page")
        .agg(
            F.bool_and("has_poly").alias("placed"),
            F.sort_array(F.collect_list(F.when(F.col("good") & F.col("has_poly"), F.struct(
                y_mean.alias("y"), "det_no", F.array_min(xs).alias("x"), strip("text").alias("t"))))).alias("b"),
            F.sort_array(F.collect_list(F.when(F.col("good"), F.struct("det_no", F.col("text").alias("t"))))).alias("plain"),
        )
    )
    y = F.transform("b", lambda d: d["y"])
    last = F.greatest(F.size("b") - 1, F.lit(0))
    gaps = F.sort_array(F.filter(
        F.zip_with(F.slice(y, 1, last), F.slice(y, 2, last), lambda p, q: q - p), lambda g: g > 2))
    mid = let(gaps, lambda g: F.try_element_at(g, (F.floor(F.size(g) / 2) + 1).cast("int")))
    band = F.greatest(F.coalesce(mid * 0.6, F.lit(15.0)), F.lit(8.0))
    # The fold keeps the band, the anchor of the current row and where rows start.
    state = F.struct(
        band.alias("band"), F.array().cast("array<int>").alias("starts"), F.lit(0.0).alias("anchor"), F.lit(0).alias("i"))

    def step(a, d):
        fresh = (a["i"] == 0) | (F.abs(d["y"] - a["anchor"]) > a["band"])
        return F.struct(
            a["band"].alias("band"),
            F.when(fresh, F.concat(a["starts"], F.array(a["i"]))).otherwise(a["starts"]).alias("starts"),
            F.when(fresh, d["y"]).otherwise(a["anchor"]).alias("anchor"),
            (a["i"] + 1).alias("i"),
        )

    starts = F.aggregate("b", state, step, lambda a: a["starts"])

    def cells(s, e):
        across = F.sort_array(F.transform(
            F.slice("b", s + 1, e - s), lambda d: F.struct(d["x"], d["y"], d["det_no"], d["t"].alias("t"))))
        return F.array_join(F.transform(across, lambda d: d["t"]), " | ")

    rows = let(starts, lambda st: F.zip_with(
        st, F.concat(F.slice(st, 2, F.greatest(F.size(st) - 1, F.lit(0))), F.array(F.size("b"))), cells))
    plain = strip(F.array_join(F.transform("plain", lambda d: d["t"]), "\n"))
    return page.select(
        "doc_id", "page", F.when(F.col("placed") & (F.size("b") > 0), F.array_join(rows, "\n")).when(F.col("placed"), F.lit("")).otherwise(plain).alias("text"))


def ocr_plan(pages: DataFrame, images: DataFrame) -> DataFrame:
    """P10: recognition settings per image from page texts and image sizes.

    A document of more than ten pages whose first five are all without text is scanned at
    150 dpi, any other at 300. Images under 100 pixels a side are skipped, and on text
    pages also those over 60 % of the page area.
    """
    dpi = pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"),
        F.bool_and(F.when(F.col("page") <= 5, is_blank("text")).otherwise(F.lit(True))).alias("blank_start"),
    ).select("doc_id", F.when((F.col("n_pages") > 10) & F.col("blank_start"), 150).otherwise(300).alias("dpi"))
    page = pages.select("doc_id", "page", is_blank("text").alias("image_only"), "page_area")
    w, h = F.col("width"), F.col("height")
    keep = (w >= 100) & (h >= 100) & (
        F.col("image_only") | (w.cast("double") * h <= F.col("page_area") * 0.6))
    return (
        images.join(page, ["doc_id", "page"]).join(dpi, "doc_id")
        .select("doc_id", "page", "image_no", "image_only", "dpi", keep.alias("keep"),
                F.least(F.lit(1.0), F.lit(1920.0) / F.greatest(w, h)).alias("scale"))
    )


def ocr_gate(results: DataFrame) -> DataFrame:
    """The alternative text wins on a large, sparsely recognised image if it is longer."""
    density = F.length("text") / F.greatest("px", F.lit(1)) * 10000
    other = (density < 5) & (F.col("px") > 50000) & (F.length("alt_text") > F.length("text"))
    return results.withColumn("chosen", F.when(other, F.col("alt_text")).otherwise(F.col("text")))
