"""Taxonomy tables and classification of documents against label vectors."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.hooks import label_scorer
from ..functions.text import let, parse_suggestion, title_case
from .vectors import similar_above

# Labels of a taxonomy are typed in by people; more than this is a mistake, not a taxonomy.
MAX_LABELS = 10_000


def taxonomy_labels(dims: DataFrame, cats: DataFrame) -> DataFrame:
    """Every dimension with its labels in name order, empty when it has none."""
    lists = cats.groupBy("dimension_id").agg(F.sort_array(F.collect_set("name")).alias("labels"))
    return dims.join(lists, "dimension_id", "left").withColumn(
        "labels", F.coalesce("labels", F.array().cast("array<string>"))).orderBy("dim_order", "dimension_id")


def label_union(cats: DataFrame, fixed=tuple(K.FIXED_LABELS)) -> DataFrame:
    """U4: (label), the taxonomy's labels and the fixed ones, each once."""
    extra = cats.sparkSession.createDataFrame([(x,) for x in fixed], "label string")
    return cats.select(F.col("name").alias("label")).union(extra).distinct()


def parse_suggestions(replies: DataFrame, column: str = "raw") -> DataFrame:
    """F17 on a table: usable (dimension_id, category_name) of each reply."""
    return replies.withColumn("s", parse_suggestion(column)).filter(F.col("s").isNotNull()).select(
        *[c for c in replies.columns if c != column], "s.*")


def merge_taxonomy(dims: DataFrame, cats: DataFrame, suggestions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dimensions and categories with the suggested ones that were missing."""
    new_dims = (
        suggestions.select("dimension_id").distinct()
        .join(dims, "dimension_id", "left_anti")
        .select("dimension_id", title_case(F.replace("dimension_id", F.lit("_"), F.lit(" "))).alias("display_name"),
                F.lit(True).alias("is_multi_label"), F.lit(0).alias("dim_order"))
    )
    new_cats = (
        suggestions.select("dimension_id", F.col("category_name").alias("name")).distinct()
        .join(cats, ["dimension_id", "name"], "left_anti")
    )
    return dims.unionByName(new_dims, allowMissingColumns=True), cats.unionByName(new_cats, allowMissingColumns=True)


def _assign(scores: DataFrame, dims: DataFrame) -> DataFrame:
    """(doc_id, classifications) from (doc_id, dimension_id, label, order, similarity)."""
    multi = F.col("is_multi_label")
    per_dim = (
        scores.join(dims.select("dimension_id", "is_multi_label"), "dimension_id")
        .filter(F.col("similarity") > F.when(multi, K.MULTI_LABEL_THRESHOLD).otherwise(K.SINGLE_LABEL_THRESHOLD))
        .groupBy("doc_id", "dimension_id")
        .agg(
            F.first("is_multi_label").alias("multi"),
            F.sort_array(F.collect_list(F.struct("order", "label"))).alias("all"),
            F.min(F.struct((-F.col("similarity")).alias("s"), "label")).alias("best"),
        )
    )
    labels = F.when(F.col("multi"), F.transform("all", lambda x: x["label"])).otherwise(F.array("best.label"))
    return per_dim.groupBy("doc_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("dimension_id", labels.alias("v"))))).alias("classifications"))


def classify(doc_vectors: DataFrame, dims: DataFrame, label_vectors: DataFrame) -> DataFrame:
    """(doc_id, classifications) by cosine to each dimension's labels.

    Multi-label dimensions take every label above 0.4 in name order, single-label ones the
    best if above 0.35. Dimensions without a result are absent, and so are documents
    without any. Label rows are shipped to the document vectors after a size check.
    """
    labels = label_vectors.select(F.struct("dimension_id", "label").alias("key"), "embedding")
    sims = similar_above(doc_vectors, labels, "doc_id", "key", K.SINGLE_LABEL_THRESHOLD)
    scores = sims.select("doc_id", "key.*", F.col("key.label").alias("order"), "similarity")
    return _assign(scores, dims)


def classify_with(docs: DataFrame, dims: DataFrame, cats: DataFrame, scorer=label_scorer, text: str = "text") -> DataFrame:
    """The same rules over a scorer `(text, labels, multi) -> map<label, score>`;
    labels come in score order."""
    packed = (
        taxonomy_labels(dims, cats).filter(F.size("labels") > 0)
        .agg(F.collect_list(F.struct("dimension_id", "is_multi_label", "labels")).alias("d"))
    )
    n = F.aggregate("d", F.lit(0), lambda a, x: a + F.size(x["labels"]))
    checked = packed.select(F.when(n > MAX_LABELS, F.raise_error(F.lit("taxonomy too large"))).otherwise(F.col("d")).alias("d"))
    pairs = docs.withColumn("dim", F.explode(checked.scalar()))
    scored = pairs.select("doc_id", "dim.dimension_id", "dim.is_multi_label",
                          scorer(F.col(text), F.col("dim.labels"), F.col("dim.is_multi_label")).alias("scores"))
    multi = F.col("is_multi_label")
    # The labels of one dimension are chosen inside the row; what is moved then is the result.
    passed = F.sort_array(F.transform(F.filter(F.map_entries("scores"), lambda e: e["value"] > F.when(
        multi, K.MULTI_LABEL_THRESHOLD).otherwise(K.SINGLE_LABEL_THRESHOLD)), lambda e: F.struct((-e["value"]).alias("order"), e["key"].alias("label"))))
    kept = lambda multi, found: F.when(multi, found).otherwise(F.slice(found, 1, 1))
    chosen = scored.withColumn("passed", passed).where(F.size("passed") > 0).select("doc_id", F.struct(
        "dimension_id", F.coalesce(multi, F.lit(False)).alias("multi"), kept(multi, F.col("passed")).alias("found")).alias("d"))

    def merged(all_rows):  # a document that comes in several rows has one entry a dimension
        def entry(k):
            same = F.filter(all_rows, lambda x: x["dimension_id"] == k)
            return let(same, lambda m: F.struct(k.alias("dimension_id"), F.transform(
                kept(F.get(m, F.lit(0))["multi"], F.sort_array(F.flatten(F.transform(m, lambda x: x["found"])))), lambda x: x["label"]).alias("v")))

        return F.transform(F.array_distinct(F.transform(all_rows, lambda x: x["dimension_id"])), entry)

    return chosen.groupBy("doc_id").agg(F.sort_array(F.collect_list("d")).alias("d")).select(
        "doc_id", F.map_from_entries(let(F.col("d"), merged)).alias("classifications"))
