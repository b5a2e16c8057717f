"""Chunks: sentence-aware windows over pages, line windows over tabular pages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import is_tabular, split_sentences, strip, text_lines

_RANGE = "array<struct<first:int,last:int,at:int>>"


def line_windows(lines: Column, size: int = K.ROWS_PER_CHUNK, overlap: int = K.OVERLAP_ROWS) -> Column:
    """Every window of `size` lines, stepping by size minus overlap."""
    starts = F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines), F.lit(size - overlap)))
    return F.transform(starts, lambda s: F.array_join(F.slice(lines, s, size), "\n"))


def _ranges(events: Column, size: int, carry: int) -> Column:
    """Sentence ranges of a page's chunks.

    Only lengths go through the fold. A range runs from its first to its last sentence and
    leaves out giants between them; `at` is the sentence that closed it. A giant closes the
    current range, and the carried sentences go on behind it.
    """
    none = F.array().cast("array<struct<i:int,n:int>>")
    state = F.struct(
        F.array().cast(_RANGE).alias("out"), none.alias("held"), F.lit(0).alias("chars"))

    def total(held):
        return F.aggregate(held, F.lit(0), lambda s, x: s + x["n"])

    def last(held, k):
        return F.slice(held, F.greatest(F.size(held) - k + 1, F.lit(1)), k)

    def span(held, at):
        return F.array(F.struct(held[0]["i"].alias("first"), F.element_at(held, -1)["i"].alias("last"), at.alias("at")))

    def step(a, e):
        close = (F.size(a["held"]) > 0) & (e["giant"] | (a["chars"] + e["n"] > size))
        kept = F.when(close, last(a["held"], carry)).otherwise(a["held"])
        one = F.array(F.struct(e["i"].alias("i"), e["n"].alias("n")))
        held = F.when(e["giant"], kept).otherwise(F.concat(kept, one))
        chars = F.when(close, total(last(a["held"], carry))).otherwise(a["chars"]) + F.when(e["giant"], 0).otherwise(e["n"])
        return F.struct(
            F.when(close, F.concat(a["out"], span(a["held"], e["i"]))).otherwise(a["out"]).alias("out"),
            held.alias("held"), chars.alias("chars"))

    def finish(a):
        return F.when(F.size(a["held"]) > 0, F.concat(a["out"], span(a["held"], F.lit(1 << 30)))).otherwise(a["out"])

    return F.aggregate(events, state, step, finish)


def chunk_pages(pages: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.OVERLAP_SENTENCES) -> DataFrame:
    """K1: (doc_id, page, part, text); `part` orders the chunks of a page.

    A chunk never crosses a page. Sentences longer than 1.5 times the size are cut into
    overlapping slices of their own. Chunks under 20 characters are dropped at the end.
    """
    giant = int(size * K.GIANT_FACTOR)
    step = size - K.GIANT_OVERLAP
    page = pages.withColumn("lines", text_lines("text")).withColumn("tabular", is_tabular("lines"))
    page = page.withColumn(
        "sents", F.when(F.col("tabular"), F.col("lines")).otherwise(split_sentences("text")))
    events = F.transform("sents", lambda s, i: F.struct(
        i.alias("i"), F.length(s).alias("n"), (F.length(s) > giant).alias("giant")))
    page = page.withColumn("ranges", F.when(~F.col("tabular"), _ranges(events, size, overlap)))
    plain = F.transform("ranges", lambda r: F.struct(
        r["at"].alias("at"), F.lit(0).alias("sub"),
        F.array_join(F.filter(F.slice("sents", r["first"] + 1, r["last"] - r["first"] + 1),
                              lambda s: F.length(s) <= giant), " ").alias("text")))
    slices = F.flatten(F.transform("sents", lambda s, i: F.when(
        F.length(s) > giant,
        F.transform(F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1)),
                    lambda p, k: F.struct(i.alias("at"), (k + 1).alias("sub"), strip(p).alias("text"))),
    ).otherwise(F.array().cast("array<struct<at:int,sub:int,text:string>>"))))
    rows = F.transform(line_windows(F.col("sents")), lambda t, i: F.struct(
        i.alias("at"), F.lit(0).alias("sub"), t.alias("text")))
    parts = F.when(F.col("tabular"), rows).otherwise(F.sort_array(F.concat(plain, slices)))
    kept = F.filter(parts, lambda p: F.length(strip(p["text"])) >= K.MIN_CHUNK_CHARS)
    return page.select("doc_id", "page", F.posexplode(kept).alias("part", "c")).select(
        "doc_id", "page", "part", F.col("c.text").alias("text"))


def number_chunks(chunks: DataFrame, max_chunks: int | None = None) -> DataFrame:
    """Chunk numbers from 0 in page order and chunk ids; with `max_chunks` up to that many a document.

    Run it after unusable vectors are dropped. The window holds one document, whose size
    the intake limit bounds.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "part")
    out = chunks.withColumn("chunk_no", F.row_number().over(w) - 1)
    if max_chunks is not None:
        out = out.filter(F.col("chunk_no") < max_chunks)
    return out.withColumn("chunk_id", F.concat_ws("_chunk_", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")))


def cap_chunks(chunks: DataFrame, max_chunks: int = K.MAX_CHUNKS_PER_DOC) -> DataFrame:
    """The ingest limit alone."""
    return number_chunks(chunks, max_chunks).select(*chunks.columns)
