"""A corpus pipeline of five stages, each a training-data operator applied to the documents that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs.
"""
from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.bpe import bpe_round_trip
from docspark.llm.common import table
from docspark.llm.jaccard_join import similar_documents
from docspark.llm.mixing import copies, mixing_rates
from docspark.llm.queries import tokenizer_path
from docspark.llm.suffix_dedup import remove_repeats
from docspark.llm.toxicity import fit, score_texts
from docspark.session import reads, remove, shared_dir, written

TOXIC = 0.5
#: Shares of tokens by quality that mixing aims at. No rate is below 1: it repeats documents, it drops none.
QUALITY = {"1": 0.9, "0": 0.1}


_made: set[str] = set()


def stage(fn):
    """A stage that first removes the intermediate tables of the stages before it: their results have
    been written by then. Tables that docs still reads stay."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _made - reads(docs))
        before = set(written)
        out = fn(spark, docs, sf_dir)
        _made.clear()
        _made.update(written - before)
        return out

    return run_stage


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go.

    A null or empty text has a score of its own (that of no words); rows that repeat an id are scored
    each by its text; rows without an id stay unless their text is toxic. Without any labelled text all stay.
    Whole texts of any length are read; all columns are handed on as they are.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    if not len(model[0]) and not model[2]:  # nothing was learned, so every score is one half
        return docs
    return score_texts(docs, model, docs.columns).where(F.col("score") < TOXIC).select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of five-word shingles of 0.8 or more, the document with the smallest id stays.

    Null, empty and blank texts link with nothing and stay, and so do rows without an id. Rows that
    repeat an id go or stay together. Equal texts are one group. An empty table stays empty.
    """
    members, _ = similar_documents(docs.select("doc_id", "text"), n=5, percent=80)
    gone = members.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; every document stays with what is its own.

    Null texts are empty afterwards; a text that is repeated as a whole becomes empty and stays. Rows
    with the same id don't cut each other, and rows without one come after all others. n_chars is counted anew.
    """
    return remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated at fitted rates, so that expected tokens by quality meet their shares.

    No rate is below 1, so no document is lost. Null and empty texts have no tokens and come as often as
    their rate says; rows that repeat an id get the greatest of their rates; rows without an id come once.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("domain"))
    rates, _ = mixing_rates(docs.select("doc_id", "text"), labels, QUALITY, least=1.0)
    rates = rates.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("rate").alias("_rate"))
    drawn = docs.join(rates, "doc_id", "left")
    often = F.greatest(copies(F.coalesce("_rate", F.lit(1.0)), F.col("doc_id")), F.lit(1))
    return drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), often))).select(*docs.columns)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text that they decode to.

    Null and empty texts have no ids. Every row, repeated or without an id, is encoded for itself.
    """
    path = tokenizer_path()
    done = bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), path)
    return done.select("doc_id", "lang", "source", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                       F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: Learned scores, suffix arrays and the tokenizer have no SQL form; stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        path = shared_dir(spark)
        step(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
