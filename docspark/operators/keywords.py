"""Keyword extraction: statistical keyphrases, semantic candidates, term counts, tags.

Words and phrases are counted inside a document's row or a batch of rows (phrases.py): no text and
no token is exchanged or sorted on disk. A row is one document, which the intake limit bounds.
"""
from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.hooks import Encoder
from ..functions.text import head, let, mentions_syllabus, strip_tags, title_case, words
from ..session import materialize
from .lexical import row_counts
from .phrases import scored_phrases
from .vectors import cosine

SEMANTIC_FLOOR = 0.45
TF_TERMS = 50
FREQUENT_WORDS = 30


def _is_stop(c: Column, stopwords: Iterable[str]) -> Column:
    return c.isin(sorted(set(stopwords)))


def keyphrases(docs: DataFrame, top: int, n: int = 2, dedup: float = 0.7,
               stopwords: Iterable[str] = K.STOPWORDS, head_chars: int | None = None) -> DataFrame:
    """K2: (doc_id, pos, phrase, score), the `top` keyphrases of each document.

    The published five-feature statistic: casing, position of the median sentence,
    normalised frequency, variety of neighbours and spread over sentences. Lower scores
    are better; a phrase too close to a better one (Levenshtein similarity above `dedup`)
    is passed over. Phrases have one or two words and come in lower case. No row leaves its task.
    """
    # Texts are cut and counted by arrays of a batch; rounding, order and choice are the JVM's.
    scored = scored_phrases(_plain_text(docs, head_chars).withColumn("text", F.make_valid_utf8("text")), n, stopwords, 2 * top)

    def alike(a, b):
        longest = F.greatest(a["n"], b["n"])  # the distance is at least the difference of the lengths
        return (1 - F.abs(a["n"] - b["n"]) / longest > dedup) & (1 - F.levenshtein(a["key"], b["key"]) / longest > dedup)

    def choose(before, phrases):
        ranked = F.sort_array(F.transform(phrases, lambda p: F.struct(
            F.round(p["score"], 12).alias("score"), p["key"].alias("key"), F.length(p["key"]).alias("n"))))
        return F.aggregate(ranked, before, lambda acc, c: F.when(
            (F.size(acc) < top) & ~F.exists(acc, lambda a: alike(a, c)), F.concat(acc, F.array(c))).otherwise(acc))

    none = F.array().cast("array<struct<score:double,key:string,n:int>>")
    # the phrases behind the first ones are only looked at where too many of those are alike
    chosen = let(choose(none, F.col("phrases")), lambda c: F.when((F.size(c) >= top) | (F.size("others") == 0), c).otherwise(choose(c, F.col("others"))))
    return scored.select("doc_id", F.posexplode(chosen).alias("pos", "k")).select(
        "doc_id", "pos", F.col("k.key").alias("phrase"), F.col("k.score").alias("score"))


def semantic_candidates(docs: DataFrame, encoder: Encoder, floor: float = SEMANTIC_FLOOR,
                        stopwords: Iterable[str] = K.STOPWORDS, max_candidates: int | None = None,
                        head_chars: int | None = None, doc_chars: int | None = None) -> DataFrame:
    """K3: (doc_id, pos, phrase, score), words and word pairs near the document's vector."""
    body = _plain_text(docs, head_chars)
    tokens = F.filter(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)),
                      lambda w: w.rlike("^[A-Za-z][a-z]{3,}$"))
    body = body.withColumn("w", tokens)
    stop = sorted(set(stopwords))
    singles = F.array_sort(F.array_distinct(F.filter("w", lambda w: ~F.lower(w).isin(stop))))
    follow = F.slice("w", 2, F.size("w"))
    pairs = F.filter(
        F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), follow, lambda a, b: F.when(
            ~F.lower(a).isin(stop) & ~F.lower(b).isin(stop), F.concat_ws(" ", a, b))),
        lambda p: p.isNotNull())
    cands = F.array_distinct(F.concat(singles, pairs))
    if max_candidates is not None:
        cands = F.slice(cands, 1, max_candidates)
    body = body.withColumn("v", encoder(head("text", doc_chars)))
    cand = body.select("doc_id", "v", F.posexplode(cands).alias("no", "phrase"))
    # rounded, so that the order of summation cannot swap equal candidates
    scored = cand.select("doc_id", "no", "phrase", F.round(cosine(F.col("v"), encoder(F.col("phrase"))), 12).alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "no")
    return scored.filter(F.col("score") > floor).select(
        "doc_id", (F.row_number().over(w) - 1).alias("pos"), "phrase", "score")


def _most_frequent(tokens: Column, top: int) -> Column:
    """array<struct<phrase, tf>> of the `top` most frequent tokens, ties by token; counted inside the row."""
    counted = F.transform(row_counts(tokens), lambda e: F.struct((-e["tf"]).alias("k"), e["term"].alias("phrase")))
    return F.transform(F.slice(F.array_sort(counted), 1, top), lambda e: F.struct(e["phrase"].alias("phrase"), (-e["k"]).alias("tf")))


def _plain_text(docs: DataFrame, head_chars: int | None) -> DataFrame:
    return docs.select("doc_id", head(strip_tags(F.coalesce("text", F.lit(""))), head_chars).alias("text"))


def tf_terms(docs: DataFrame, top: int = TF_TERMS, stopwords: Iterable[str] = K.STOPWORDS,
             head_chars: int | None = None) -> DataFrame:
    """K4: (doc_id, pos, phrase, tf, weight), the most frequent words and word pairs left
    after stop words are removed; weight is 1 + ln(tf). No row leaves its task."""
    stop = sorted(set(stopwords))
    body = _plain_text(docs, head_chars).select(
        "doc_id", F.filter(words("text"), lambda t: (F.length(t) > 1) & ~t.isin(stop)).alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")),
                       lambda a, b: F.concat_ws(" ", a, b))
    best = body.select("doc_id", F.posexplode(_most_frequent(F.concat("w", pairs), top)).alias("pos", "e"))
    return best.select("doc_id", "pos", "e.phrase", "e.tf", (1 + F.log("e.tf")).alias("weight"))


def frequent_words(docs: DataFrame, top: int = FREQUENT_WORDS, min_count: int = 2,
                   stopwords: Iterable[str] = K.STOPWORDS, head_chars: int | None = None) -> DataFrame:
    """K5: (doc_id, pos, phrase, tf), plain words of five letters or more, used repeatedly. No row leaves its task."""
    stop = sorted(set(stopwords))
    plain = F.filter(words("text"), lambda t: t.rlike("^[a-z]{5,}$") & ~t.isin(stop))
    best = _plain_text(docs, head_chars).select("doc_id", F.posexplode(_most_frequent(plain, top)).alias("pos", "e"))
    return best.select("doc_id", "pos", "e.phrase", "e.tf").filter(F.col("tf") >= min_count)


def content_keywords(docs: DataFrame, n: int, encoder: Encoder | None = None,
                     stopwords: Iterable[str] = K.STOPWORDS, head_chars: int | None = None) -> DataFrame:
    """K6: (doc_id, pos, tag), the first n acceptable phrases of the stages K2 to K5.

    A later stage only fills what the earlier ones leave open, so the first n of all stages
    in order are the same as running them one after the other. The keyphrases are written; only
    the texts of documents that they leave short of n are written too and go through the other
    stages.
    """
    first = materialize(_acceptable(keyphrases(docs, 3 * n, stopwords=stopwords, head_chars=head_chars), 1))
    done = first.select("doc_id", "key").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") >= n)
    short = materialize(docs.select("doc_id", "text").join(done, "doc_id", "left_anti"))
    stages = [first]
    if encoder is not None:
        stages.append(_acceptable(
            semantic_candidates(short, encoder, stopwords=stopwords, head_chars=head_chars), 2))
    stages.append(_acceptable(tf_terms(short, stopwords=stopwords, head_chars=head_chars), 3))
    stages.append(_acceptable(frequent_words(short, stopwords=stopwords, head_chars=head_chars), 4))
    best = (
        reduce(DataFrame.unionByName, stages)
        .groupBy("doc_id", "key")
        .agg(F.min(F.struct("stage", "pos", "phrase")).alias("b"))
    )
    w = Window.partitionBy("doc_id").orderBy("b.stage", "b.pos")
    return (
        best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
        .select("doc_id", (F.col("place") - 1).alias("pos"), title_case("b.phrase").alias("tag"))
    )


def _acceptable(phrases: DataFrame, stage: int) -> DataFrame:
    key = F.lower(F.trim("phrase"))
    return phrases.select("doc_id", "pos", "phrase", key.alias("key"), F.lit(stage).alias("stage")).filter(
        (F.length("key") >= 4) & ~F.col("key").rlike("^[0-9]"))


def exclude_labels(tags: DataFrame, labels: DataFrame, keep: int = 8) -> DataFrame:
    """(doc_id, pos, tag) without taxonomy labels in any case, first `keep` a document."""
    known = labels.select(F.lower("label").alias("key")).distinct()
    left = tags.withColumn("key", F.lower("tag")).join(known, "key", "left_anti").drop("key")
    w = Window.partitionBy("doc_id").orderBy("pos")
    return (
        left.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep)
        .select("doc_id", (F.col("place") - 1).alias("pos"), "tag")
    )


def collect_tags(tags: DataFrame) -> DataFrame:
    """(doc_id, tags) in position order."""
    return tags.groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias("tags"))


def document_tags(docs: DataFrame, labels: DataFrame, encoder: Encoder | None = None, n: int = 10,
                  keywords=content_keywords) -> DataFrame:
    """K7 at ingest: (doc_id, tags) for documents that have any."""
    return collect_tags(exclude_labels(keywords(docs, n, encoder=encoder), labels))


def rule_based_tags(docs: DataFrame, encoder: Encoder | None = None, n: int = 3, keywords=content_keywords,
                    head_chars: int | None = None) -> DataFrame:
    """K7 without a model: sorted distinct tags of every document, plus "Syllabus" where the
    file name or the text says so."""
    tags = collect_tags(keywords(docs, n, encoder=encoder))
    named = F.lower(F.concat_ws(" ", "filename", head(F.coalesce("text", F.lit("")), head_chars))).contains("syllabus")
    none = F.array().cast("array<string>")
    return docs.join(tags, "doc_id", "left").select("doc_id", F.array_sort(F.array_distinct(F.concat(
        F.coalesce("tags", none), F.when(named, F.array(F.lit("Syllabus"))).otherwise(none)))).alias("tags"))


def is_syllabus(docs: DataFrame) -> DataFrame:
    """F18."""
    return docs.withColumn("is_syllabus", mentions_syllabus("filename", "text"))


def expand_query(queries: DataFrame, stopwords: Iterable[str] = K.STOPWORDS) -> DataFrame:
    """(query_id, phrase), up to three keyphrases of queries with four words or more.

    The four best phrases are looked at; single words that the query already holds add
    nothing and are passed over.
    """
    long = queries.withColumn("w", F.filter(words("text"), lambda t: F.length(t) > 1)).filter(F.size("w") >= 4)
    found = keyphrases(long.select(F.col("query_id").alias("doc_id"), "text"), 4, stopwords=stopwords)
    new = found.withColumnRenamed("doc_id", "query_id").join(long.select("query_id", "w"), "query_id").filter(
        F.col("phrase").contains(" ") | ~F.array_contains("w", F.lower("phrase")))
    w = Window.partitionBy("query_id").orderBy("pos")
    return new.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= 3).select("query_id", "phrase")
