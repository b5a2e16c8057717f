"""The registered queries of the training-data operators, with production parameters.

Each applies its operator to its whole table and derives the agreed digest columns from the
operator's own output.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode
from .chat import format_conversations, read_back
from .common import held_out, table
from .hard_negatives import hard_negatives
from .jaccard_join import similar_documents
from .langid import identify
from .merkle import fold, manifest, path_digest
from .mixing import mix
from .ngram_lm import score_texts, train
from .packing import cut, pack
from .suffix_dedup import remove_repeats
from .top_products import top_products
from .toxicity import toxicity
from .vector_dups import near_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


@query("op2_vector_dups")
def op2(spark, d):
    return near_vectors(table(spark, d, "embeddings"))


def _whole_vectors(spark, d, scale: int = 64):
    """Every component x as floor(scale x); null where the vector is null or holds null or non-finite components."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table(spark, d, "embeddings").select("vec_id", "label", F.when(fine, F.transform(
        "embedding", lambda x: F.floor(x.cast("double") * scale))).alias("vec"))


@query("op7_top_products", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vec::DOUBLE[], c.vec::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op7(spark, d):
    rows = _whole_vectors(spark, d)
    return top_products(rows, rows.where(F.col("vec_id") % 20 == 0), 20)


@query("op8_chat_format", """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(text, '\\', '\\\\') AS b, replace(replace(role, '\\', '\\\\'), chr(10), '\\' || chr(10)) AS r FROM c),
f AS (SELECT *, replace(replace(replace(replace(b, '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]') AS body,
    replace(replace(replace(replace(r, '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]') AS name FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (3 + sum(CASE WHEN role = 'assistant' THEN length(body) + 4 ELSE length(name) + length(body) + 14 END))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id""")
def op8(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], rows.schema))
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = rows.withColumn("message", F.struct("turn", place.alias("place")))
    # Each row is the log of one message: it opens with the first half of its text, the rest comes as a delta.
    half = F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("seq"), F.lit("message").alias("event"), F.col("role").alias("by"), F.substring("text", F.lit(1), half).alias("part")),
                    F.struct(F.lit(1).alias("seq"), F.lit("delta").alias("event"), F.lit(None).cast("string").alias("by"), F.col("text").substr(half + 1, F.length("text")).alias("part")))
    events = rows.select("conv_id", "message", F.explode(parts).alias("e")).select(
        "conv_id", "message", "e.seq", "e.event", F.col("e.by").alias("role"), F.col("e.part").alias("text"))
    return read_back(format_conversations(events))


@query("op9_language_id")
def op9(spark, d):
    docs = table(spark, d, "documents").select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang", "text")
    return identify(docs.drop("lang"), docs.where(~F.col("held_out")).select("lang", "text"))


@query("op3_toxicity")
def op3(spark, d):
    docs = table(spark, d, "documents").select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text")
    scored = toxicity(docs, table(spark, d, "labels"), learn=docs.where(~F.col("held_out")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op5_bpe_codec")
def op5(spark, d):
    path = tokenizer_path()
    ids = bpe_encode(table(spark, d, "documents").select("doc_id", "text"), path).drop("text")
    both = bpe_decode(ids, path)
    return both.select("doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query("op10_jaccard_join")
def op10(spark, d):
    return similar_documents(table(spark, d, "documents").select("doc_id", "text"), n=3, percent=90)[0]


@query("op4_suffix_dedup")
def op4(spark, d):
    cut = remove_repeats(table(spark, d, "documents").select("doc_id", "text"), with_text=False)
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


#: Shares of tokens that op1 aims at, by quality and toxicity.
WEIGHTS = {"quality_1_toxic_0": 0.85, "quality_0_toxic_0": 0.12, "quality_1_toxic_1": 0.02, "quality_0_toxic_1": 0.01}


def domain_labels(spark, d):
    name = F.concat(F.lit("quality_"), F.col("quality").cast("string"), F.lit("_toxic_"), F.col("toxic").cast("string"))
    return table(spark, d, "labels").select("doc_id", name.alias("domain"))


@query("op1_mixing")
def op1(spark, d):
    m = mix(table(spark, d, "documents").select("doc_id", "text"), domain_labels(spark, d), WEIGHTS)
    return m.rates.select("doc_id", "n_tokens", F.round("rate", 6).alias("rate"),
                          *[F.round(f"p{k}", 6).alias(f"p_{x}") for k, x in enumerate(m.domains)],
                          F.lit(m.steps).alias("fit_steps"), F.lit(m.converged).alias("fit_converged"))


@query("op6_lm_score")
def op6(spark, d):
    docs = table(spark, d, "documents").select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "text")
    return score_texts(docs, train(docs.where(~F.col("held_out"))))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def _leaf_sql(text: str) -> str:
    part = "coalesce(strlen({0}) || ':' || {0}, '-')"
    return "sha256(" + " || ".join(part.format(text if c == "text" else f"{c}::VARCHAR") for c in _LEAF) + ")"


@query("op13_merkle_manifest", f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('+' || source, '') AS tree, {_leaf_sql("text")} AS leaf, {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS forged,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, (c & 1) * 3988292384)))) % 5 = 0 AS bad FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS total FROM d),
n AS (SELECT 0 AS lv, tree, pos, total, leaf AS h FROM l
    UNION ALL SELECT lv + 1, tree, pos // 16, (total + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM n WHERE total > 1 GROUP BY lv, tree, pos // 16, total),
s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS total FROM n WHERE total = 1),
m AS (SELECT 0 AS lv, pos, total, subroot AS h FROM s
    UNION ALL SELECT lv + 1, pos // 16, (total + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM m WHERE total > 1 GROUP BY lv, pos // 16, total),
a AS (SELECT lv, tree, pos, total, coalesce(string_agg(h, '') OVER (PARTITION BY lv, tree, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') OVER (PARTITION BY lv, tree, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM n),
b AS (SELECT lv, pos, total, coalesce(string_agg(h, '') OVER (PARTITION BY lv, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') OVER (PARTITION BY lv, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM m),
f AS (SELECT doc_id, leaf, tree, 0 AS lv, pos, total, CASE WHEN bad THEN forged ELSE leaf END AS acc, '' AS sibs FROM l
    UNION ALL SELECT f.doc_id, f.leaf, f.tree, f.lv + 1, f.pos // 16, (f.total + 15) // 16, sha256(before || acc || after), sibs || before || after
    FROM f JOIN a ON a.lv = f.lv AND a.tree = f.tree AND a.pos = f.pos WHERE f.total > 1),
g AS (SELECT doc_id, leaf, subroot, 0 AS lv, s.pos, s.total, acc, sibs FROM f JOIN s USING (tree) WHERE f.total = 1
    UNION ALL SELECT g.doc_id, g.leaf, g.subroot, g.lv + 1, g.pos // 16, (g.total + 15) // 16, sha256(before || acc || after), sibs || before || after
    FROM g JOIN b ON b.lv = g.lv AND b.pos = g.pos WHERE g.total > 1)
SELECT doc_id, leaf, subroot, h AS root, sha256(sibs) AS proof_sha256, acc AS folded_root, acc = h AS verified
FROM g, (SELECT h FROM m WHERE total = 1) WHERE g.total = 1""")
def op13(spark, d):
    docs = table(spark, d, "documents")
    forged = {"text": F.translate("text", _UPPER, _LOWER)}
    proved = manifest(docs, _LEAF, "source", "doc_id", forged, F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0)
    folded = proved.withColumn("folded_root", fold(F.col("claim"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def byte_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op11_best_fit_packing")
def op11(spark, d):
    pieces = cut(table(spark, d, "documents"), byte_tokenizer_path(), 1024, 2)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), 1024)


@query("op12_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_dot_product(q.vec, c.vec)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5)
SELECT anchor_id, positive_id, rank, vec_id AS negative_id, positive_score, score AS negative_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score) WHERE rank <= 3""")
def op12(spark, d):
    rows = _whole_vectors(spark, d, 256)
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.where(F.col("vec_id") % 50 == 0))
