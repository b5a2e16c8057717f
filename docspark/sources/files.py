"""Files in: reading text files, intake checks and catalog registration."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import empty_entities, file_extension, normalize_text, strip


def decode_text(content):
    """UTF-8 bytes to text; bytes that do not decode are left out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def decode_text_files(files: DataFrame, nfkc=None) -> DataFrame:
    """S1 on binary rows: (path, content) to (path, text), decoded, stripped, normalised."""
    return files.select("path", normalize_text(strip(decode_text(F.col("content"))), nfkc).alias("text"))


def read_text_corpus(spark: SparkSession, path: str, nfkc=None) -> DataFrame:
    """Every text file under `path` as one row; other formats are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .filter(file_extension("path").isin(K.TEXT_EXTENSIONS))
    )
    return decode_text_files(files, nfkc)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes only; file contents are pruned from the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def accept_files(files: DataFrame, max_bytes: int = K.MAX_UPLOAD_BYTES) -> DataFrame:
    """Every file, with `accepted`, the reason for a rejection, and whether its name is a
    `duplicate_name`: another file of that name has a smaller path. Both are kept.
    """
    first = files.groupBy("name").agg(F.min("path").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("name", "_first")
    ext = file_extension("name")
    reason = (
        F.when(~ext.isin(K.ALLOWED_EXTENSIONS), "unsupported format")
        .when(F.col("length") > max_bytes, "too large")
    )
    return files.join(first, "name", "left").select(
        "path", "name", "length", reason.isNull().alias("accepted"), reason.alias("reason"),
        F.coalesce(F.col("path") > F.col("_first"), F.lit(False)).alias("duplicate_name"),
    )


def register_documents(files: DataFrame) -> DataFrame:
    """S3: new catalog rows. Ids derive from path and length, so a repeated run gives the
    same ids."""
    none = F.lit(None)
    return files.select(
        F.md5(F.concat_ws("|", "path", F.col("length").cast("string"))).alias("doc_id"),
        F.col("name").alias("filename"),
        F.lit(0).cast("bigint").alias("file_size_bytes"),
        F.lit(0).alias("page_count"),
        none.cast("string").alias("summary"),
        none.cast("array<string>").alias("tags"),
        none.cast("map<string,array<string>>").alias("classifications"),
        none.cast("array<string>").alias("key_findings"),
        empty_entities().alias("entities"),
        F.lit("other").alias("doc_type"),
        F.lit("processing").alias("status"),
        none.cast("string").alias("error_message"),
        F.current_timestamp().alias("upload_date"),
    )
