"""Registered queries and their twins, one pair per operator, under one name.

Every query reads whole tables and gives scalar columns, arrays joined by '|'.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.functions import constants as K
from docspark.functions import hooks, tags as TG, text as T
from docspark.operators import catalog as C, chunking, classify as CL, fusion, keywords as KW
from docspark.operators import lexical, maintain as U, paging, quality as Q, vectors as V
from docspark.plans import ingest as PI, search as PS
from docspark.session import materialize, shared_dir, spread
from docspark.sources import files as SF, tables as ST
from docspark.streaming import ingest as SI, live as LV, progress as SP

from . import inputs as I
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
q_ = S.quote


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def joined(c):
    return F.array_join(c, "|")


def big(c):
    return F.col(c).cast("bigint").alias(c) if isinstance(c, str) else c.cast("bigint")


def lj(x):
    return f"array_to_string({x}, '|')"


# --- Sources ------------------------------------------------------------------

@query("s1_read_text_corpus", f"SELECT '/in/' || doc_id || '.txt' AS path, {S.strip('text')} AS text FROM documents")
def s1(spark, d):
    raw = I.documents(spark, d).select(
        F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.concat(F.lit(b"\xff"), F.encode("text", "UTF-8"), F.lit(b"\x80")).alias("content"))
    return SF.decode_text_files(raw)


def _files(spark, d):
    name = F.regexp_replace(I.filename(), "^doc_[0-9]+", "")
    return I.documents(spark, d).select(
        F.concat(F.lit("/in/"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path"),
        F.concat(F.initcap("lang"), F.lit("_"), "source", F.upper(name)).alias("name"),
        (F.col("n_chars") * 10000).alias("length"))


_FILES = (f"SELECT '/in/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS path, upper(substring(lang, 1, 1)) || substring(lang, 2) || '_' || source || "
          f"upper((['.pdf', '.docx', '.txt', '.md', '.json', '.exe'])[{S.SRC} % 6 + 1]) AS name, n_chars * 10000 AS length FROM documents")


@query("s2_accept_files", f"""
    WITH f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) AS r FROM ({_FILES})),
    g AS (SELECT path, name, length, CAST(r > 1 AS INT) AS duplicate_name, CASE WHEN {S.EXT.format('name')} NOT IN {S.in_list(K.ALLOWED_EXTENSIONS)} THEN 'unsupported format'
      WHEN length > {K.MAX_UPLOAD_BYTES} THEN 'too large' END AS reason FROM f)
    SELECT path, name, length, CAST(reason IS NULL AS INT) AS accepted, coalesce(reason, '') AS reason, duplicate_name FROM g""")
def s2(spark, d):
    return SF.accept_files(_files(spark, d)).select(
        "path", "name", "length", F.col("accepted").cast("int").alias("accepted"), F.coalesce("reason", F.lit("")).alias("reason"),
        F.col("duplicate_name").cast("int").alias("duplicate_name"))


@query("s3_register_documents", f"""
    SELECT md5(path || '|' || length) AS doc_id, name AS filename, 0::BIGINT AS file_size_bytes, 0::INT AS page_count, 'processing' AS status
    FROM ({_FILES})""")
def s3(spark, d):
    return SF.register_documents(_files(spark, d)).select("doc_id", "filename", "file_size_bytes", "page_count", "status")


_CATALOG_COLUMNS = S.build(
    "SELECT doc_id, filename, status, array_to_string(tags, '|') AS tags, lang AS language, array_to_string(subject, '|') AS subject, 0::INT AS n_entities FROM catalog",
    "catalog")


@query("s4_read_catalog", _CATALOG_COLUMNS)
def s4(spark, d):
    cat = I.catalog(spark, d)
    path = shared_dir(spark)
    ST.write_catalog(cat.withColumns({
        "tags": F.when(F.size("tags") > 0, F.to_json("tags")).otherwise(""),
        "classifications": F.to_json("classifications"),
        "entities": F.lit(None).cast("string"),
    }), path)
    return ST.read_catalog(spark, path).select(
        "doc_id", "filename", "status", joined("tags").alias("tags"), F.col("classifications.language")[0].alias("language"),
        joined("classifications.subject").alias("subject"), F.size("entities.Dates").alias("n_entities"))


@query("s5_write_index", S.build("""
    SELECT doc_id || '_chunk_' || n AS chunk_id, doc_id, n AS chunk_no, page, first, coalesce(n_terms, 0) AS n_terms FROM (
      SELECT doc_id, page, round(embedding[1]::DOUBLE, 6) AS first, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS n FROM vecs WHERE label <> 3)
    LEFT JOIN (SELECT doc_id, count(*) AS n_terms FROM postings GROUP BY 1) USING (doc_id)""", "vecs", "postings"))
def s5(spark, d):
    vecs = I.vectors(spark, d).withColumn("embedding", F.when(
        F.col("label") == 3, F.transform("embedding", lambda x: x * float("nan"))).otherwise(F.col("embedding"))).withColumn("part", F.lit(0))
    good = chunking.number_chunks(V.finite_vectors(vecs.drop("chunk_id")))
    path = shared_dir(spark)
    chunks = good.select("chunk_id", "doc_id", "chunk_no", "page")
    ST.write_index(chunks, good.select("chunk_id", "doc_id", "embedding"), lexical.build_postings(I.documents(spark, d)), path, buckets=8)
    t = ST.read_index(spark, path)
    terms = t["postings"].groupBy("doc_id").agg(F.count("*").alias("n_terms"))
    return t["chunks"].join(t["vectors"].select("chunk_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first")), "chunk_id").join(terms, "doc_id", "left").select(
        "chunk_id", "doc_id", big("chunk_no"), big("page"), "first", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))


@query("u1_update_index", """
    SELECT doc_id, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE 'old' END AS v, source AS term
    FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 7 = 0""")
def u1b(spark, d):
    """Deletes and replaces documents of a written index: only their buckets are written again."""
    docs, path = I.documents(spark, d), shared_dir(spark)
    parts = lambda rows, tag, more: {"chunks": rows.select("doc_id", (F.col("n_chars") + more).alias("size")),
                                     "vectors": rows.select("doc_id", F.lit(tag).alias("v")), "postings": rows.select("doc_id", F.col("source").alias("term"))}
    ST.write_index(**parts(docs, "old", 0), path=path, buckets=256)
    ST.update_index(spark, path, docs.where("doc_id % 7 = 0 OR doc_id % 11 = 0"), parts(docs.where("doc_id % 7 = 0"), "new", 1), buckets=256)
    t = ST.read_index(spark, path)
    return t["chunks"].join(t["vectors"], "doc_id", "full").join(t["postings"].drop("bucket"), "doc_id", "full")


@query("s6_document_text", "SELECT item_id * 11 AS doc_id, coalesce(d.text, '') AS text, CASE WHEN d.text IS NULL THEN 'missing' ELSE 'found' END AS status "
                           "FROM benchmark b LEFT JOIN documents d ON d.doc_id = item_id * 11")
def s6(spark, d):
    ids = I.table(spark, d, "benchmark").select((F.col("item_id") * 11).alias("doc_id"))
    return C.document_text(I.documents(spark, d), ids).withColumn("text", F.coalesce("text", F.lit("")))


# --- Filters and listings -----------------------------------------------------

_LIST_COLS = "doc_id, filename, status, coalesce(doc_type, {dt}) AS doc_type, array_to_string(tags, '|') AS tags"


def _listing(df):
    return df.select("doc_id", "filename", "status", "doc_type", joined("tags").alias("tags"))


@query("p1_list_documents", S.build(f"SELECT {_LIST_COLS.format(dt=S.doc_type_of('tags'))} FROM catalog", "catalog"))
def p1(spark, d):
    return _listing(C.list_documents(I.catalog(spark, d)))


@query("p1_list_by_type", S.build(f"SELECT * FROM (SELECT {_LIST_COLS.format(dt=S.doc_type_of('tags'))} FROM catalog) WHERE doc_type = 'syllabus'", "catalog"))
def p1b(spark, d):
    return _listing(C.list_documents(I.catalog(spark, d), doc_type="syllabus"))


@query("p1_list_by_tag_and_value", S.build(
    f"SELECT {_LIST_COLS.format(dt=S.doc_type_of('tags'))} FROM catalog WHERE list_contains(tags, 'Homework') AND lang = 'en'", "catalog"))
def p1c(spark, d):
    return _listing(C.list_documents(I.catalog(spark, d), tag="Homework", dimension="language", value="en"))


@query("p2_completed_only", S.build("SELECT doc_id, filename FROM base WHERE status = 'completed'", "base"))
def p2(spark, d):
    return C.completed_only(I.catalog(spark, d, tags=False)).select("doc_id", "filename")


def _untagged(spark, d):
    """The catalog with placeholders where the source number says so."""
    n = F.substring(F.col("classifications.source")[0], 4, 9).cast("int")
    tags = (F.when(n == 10, F.array(F.lit("Uncategorized"))).when(n == 11, F.array(F.lit("General")))
            .when(n == 12, F.array().cast("array<string>")).when(n == 13, None).otherwise(F.array(F.lit("Kept"), F.lit("General"))))
    summary = F.when(n == 14, "AI summary pending").when(n == 15, "").when(n == 16, None).otherwise(F.col("summary"))
    return I.catalog(spark, d, tags=False).withColumns({"tags": tags, "summary": summary})


_NEEDS = f"({S.SRC} BETWEEN 10 AND 16 OR summary = '')"


@query("p3_needs_retag", S.build(f"SELECT doc_id, status FROM base WHERE {_NEEDS}", "base"))
def p3(spark, d):
    return C.needs_retag(_untagged(spark, d)).select("doc_id", "status")


@query("p3_needs_retag_forced", S.build("SELECT doc_id, status FROM base WHERE status = 'completed'", "base"))
def p3b(spark, d):
    return C.needs_retag(_untagged(spark, d), force=True).select("doc_id", "status")


def _unclassified(spark, d):
    cat = I.catalog(spark, d, tags=False).join(I.documents(spark, d).select("doc_id", "text", "lang"), "doc_id")
    none = F.create_map().cast("map<string,array<string>>")
    return cat.withColumn("classifications", F.when(F.col("lang") == "en", F.col("classifications")).when(
        F.col("lang") == "fr", none).otherwise(F.lit(None)))


@query("p4_needs_classification", S.build(f"SELECT doc_id, lang FROM base WHERE status = 'completed' AND lang <> 'en' AND {S.strip('text')} <> ''", "base"))
def p4(spark, d):
    return C.needs_classification(_unclassified(spark, d)).select("doc_id", "lang")


_NOW = "2024-01-01 05:00:00"


def _now():
    return F.to_timestamp(F.lit(_NOW))


_STALE = f"status = 'processing' AND upload_date < TIMESTAMP '{_NOW}' - INTERVAL 2 HOUR"


@query("p5_stale_processing", S.build(
    f"SELECT doc_id, CASE WHEN {_STALE} THEN 'failed' ELSE status END AS status, "
    f"coalesce(CASE WHEN {_STALE} THEN {q_(K.STALE_MESSAGE)} ELSE error_message END, '') AS error_message FROM base", "base"))
def p5(spark, d):
    return C.stale_processing(I.catalog(spark, d, tags=False), _now()).select(
        "doc_id", "status", F.coalesce("error_message", F.lit("")).alias("error_message"))


@query("p6_stale_versions", S.build("SELECT chunk_id, model_version FROM vecs WHERE model_version IS NOT NULL AND model_version <> 'v1'", "vecs"))
def p6(spark, d):
    return C.stale_versions(I.vectors(spark, d), "v1").select("chunk_id", "model_version")


@query("p7_finite_vectors", "SELECT vec_id, label FROM embeddings WHERE label NOT IN (3, 4)")
def p7(spark, d):
    e = I.table(spark, d, "embeddings")
    bad = F.when(F.col("label") == 3, float("nan")).when(F.col("label") == 4, float("inf"))
    return V.finite_vectors(e.withColumn("embedding", F.when(bad.isNull(), F.col("embedding")).otherwise(
        F.transform("embedding", lambda x: x * bad)))).select("vec_id", "label")


@query("p8_retryable", S.build("SELECT doc_id, 'processing' AS status, '' AS error_message FROM base WHERE status <> 'completed'", "base"))
def p8(spark, d):
    return C.retryable(I.catalog(spark, d, tags=False)).select("doc_id", "status", F.coalesce("error_message", F.lit("")).alias("error_message"))


def _tab(x):
    return (f"len({x}) >= 6 AND list_sum(list_transform({x}, lambda s: length(s))) / len({x}) < 100 "
            f"AND len(list_filter({x}, lambda s: regexp_matches(s, '[.!?]$'))) / len({x}) < 0.15 "
            f"AND len(list_filter({x}, lambda s: regexp_matches(s, '^[A-Z0-9]{{1,8}}\\b'))) / len({x}) >= 0.30")


_ALLPAGES = "SELECT 'e' AS kind, doc_id, page, text FROM evpages UNION ALL SELECT 'd', doc_id, page, text FROM pages"


@query("p9_is_tabular", S.build(
    f"SELECT kind, doc_id, page, CAST(coalesce({_tab('l')}, false) AS INT) AS tabular FROM (SELECT *, {S.lines('text')} AS l FROM ({_ALLPAGES}))", "evpages", "pages"))
def p9(spark, d):
    pages = I.event_pages(spark, d).withColumn("kind", F.lit("e")).unionByName(I.document_pages(spark, d).withColumn("kind", F.lit("d")))
    return pages.withColumn("l", T.text_lines("text")).select(
        "kind", "doc_id", big("page"), F.coalesce(T.is_tabular("l"), F.lit(False)).cast("int").alias("tabular"))


@query("p10_ocr_plan", S.build(f"""
    SELECT c.doc_id, c.page, 1 AS image_no, CAST(role <> 'assistant' AS INT) AS image_only, CASE WHEN n > 10 AND blank THEN 150 ELSE 300 END AS dpi,
      CAST(w >= 100 AND h >= 100 AND (role <> 'assistant' OR w * h <= 480000.0 * 0.6) AS INT) AS keep, round(least(1.0, 1920.0 / greatest(w, h)), 6) AS scale
    FROM (SELECT *, length(text) * 7 % 3000 + 40 AS w, length(text) * 3 % 2000 + 60 AS h FROM conv) c
    JOIN (SELECT doc_id, count(*) AS n, bool_and(page > 5 OR role <> 'assistant') AS blank FROM conv GROUP BY 1) USING (doc_id)""", "conv"))
def p10(spark, d):
    return paging.ocr_plan(I.scanned_pages(spark, d), I.images(spark, d)).select(
        "doc_id", big("page"), "image_no", F.col("image_only").cast("int").alias("image_only"), "dpi",
        F.col("keep").cast("int").alias("keep"), F.round("scale", 6).alias("scale"))


@query("p11_ocr_gate", """
    SELECT conv_id, turn, CASE WHEN length(text) / greatest(px, 1) * 10000 < 5 AND px > 50000 AND length(alt) > length(text) THEN alt ELSE text END AS chosen FROM (
      SELECT conv_id, turn, text, role || repeat('x', CAST(turn AS INT) * 200) AS alt, conv_id * 9000 AS px FROM conversations)""")
def p11(spark, d):
    r = I.table(spark, d, "conversations").select(
        "conv_id", "turn", "text", F.concat("role", F.repeat(F.lit("x"), F.col("turn").cast("int") * 200)).alias("alt_text"),
        (F.col("conv_id") * 9000).alias("px"))
    return paging.ocr_gate(r).select("conv_id", "turn", "chosen")


@query("p12_present_documents", S.build(f"""
    SELECT doc_id, filename, CASE WHEN file_size_bytes > 0 THEN printf('%.1f', floor(file_size_bytes / 1024 * 10 + 0.5) / 10) || ' KB' ELSE '' END AS size_label,
      CASE WHEN page_count > 0 THEN page_count || (CASE WHEN page_count <> 1 THEN ' pgs' ELSE ' pg' END) ELSE '' END AS page_label,
      array_to_string(CASE WHEN len(subject) > 0 THEN subject[1:2] ELSE tags[1:2] END, '|') AS pills,
      array_to_string(tags[1:3], '|') AS shown_tags, {S.collapse('summary')} AS summary_line, {S.ellipsis(S.collapse('summary'), 80, 78)} AS short_summary FROM catalog""", "catalog"))
def p12(spark, d):
    p = C.present_documents(I.catalog(spark, d))
    return p.select("doc_id", "filename", "size_label", "page_label", joined("pills").alias("pills"),
                    joined("shown_tags").alias("shown_tags"), "summary_line", "short_summary")


@query("p14_ingest_status", S.build("""
    SELECT i.doc_id, coalesce(b.status, 'missing') AS status,
      CASE WHEN b.status IS NULL THEN '' ELSE coalesce(p.step, CASE WHEN b.status = 'processing' THEN 'queued' ELSE b.status END) END AS step,
      CASE WHEN b.status IS NULL THEN -1 ELSE coalesce(p.pct, CASE WHEN b.status = 'completed' THEN 100 ELSE 0 END) END AS pct,
      CASE WHEN b.status IS NULL THEN '' ELSE coalesce(p.detail, CASE WHEN b.status = 'processing' THEN 'Waiting to start…' ELSE '' END) END AS detail
    FROM (SELECT vec_id * 2 AS doc_id FROM embeddings) i LEFT JOIN base b USING (doc_id) LEFT JOIN lastp p USING (doc_id)""", "base", "lastp"))
def p14(spark, d):
    ids = I.table(spark, d, "embeddings").select((F.col("vec_id") * 2).alias("doc_id"))
    s = C.ingest_status(I.catalog(spark, d, tags=False), SP.latest_progress(I.progress(spark, d)), ids)
    return s.select("doc_id", "status", F.coalesce("step", F.lit("")).alias("step"), F.coalesce("pct", F.lit(-1)).alias("pct"),
                    F.coalesce("detail", F.lit("")).alias("detail"))


# --- Joins --------------------------------------------------------------------

@query("j1_docs_with_text", S.build("SELECT b.doc_id, b.status, coalesce(x.text, '') AS text FROM base b LEFT JOIN documents x ON x.doc_id + 100 = b.doc_id", "base"))
def j1(spark, d):
    texts = I.documents(spark, d).withColumn("doc_id", F.col("doc_id") + 100)  # some documents have no text, some texts no document
    return C.docs_with_text(I.catalog(spark, d, tags=False), texts).select("doc_id", "status", "text")


@query("j2_attach_metadata", S.build("SELECT query_id, chunk_id, filename, summary FROM hits", "hits"))
def j2(spark, d):
    return _looked_up(spark, d).select("query_id", "chunk_id", "filename", "summary")


@query("j3_taxonomy_labels", S.build("""
    SELECT dimension_id, display_name, CAST(is_multi_label AS INT) AS is_multi_label, dim_order, coalesce(array_to_string(l, '|'), '') AS labels
    FROM dims LEFT JOIN (SELECT dimension_id, list(name ORDER BY name) AS l FROM cats GROUP BY 1) USING (dimension_id)""", "dims", "cats"))
def j3(spark, d):
    return CL.taxonomy_labels(I.dimensions(spark), I.categories(spark, d)).select(
        "dimension_id", "display_name", F.col("is_multi_label").cast("int").alias("is_multi_label"), "dim_order", joined("labels").alias("labels"))


@query("u4_label_union", S.build(f"SELECT name AS label FROM cats UNION SELECT unnest({S.str_list(K.FIXED_LABELS)})", "cats"))
def u4(spark, d):
    return CL.label_union(I.categories(spark, d))


def _tag_rows(spark, d):
    return KW.frequent_words(I.documents(spark, d)).select("doc_id", "pos", T.title_case("phrase").alias("tag"))


def _some_labels(spark, d):
    """Every benchmark word is taken for a taxonomy label."""
    return I.table(spark, d, "benchmark").select(F.explode(T.words("text")).alias("label"))


@query("j4_exclude_labels", S.build(f"""
    SELECT doc_id, place - 1 AS pos, tag FROM (
      SELECT doc_id, {S.title_word('phrase')} AS tag, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM freq
      WHERE pos < 30 AND tf >= 2 AND phrase NOT IN (SELECT unnest({S.words('text')}) FROM benchmark)) WHERE place <= 8""", "freq"))
def j4(spark, d):
    return KW.exclude_labels(_tag_rows(spark, d), _some_labels(spark, d)).select("doc_id", big("pos"), "tag")


def _keyword(spark, d):
    return lexical.keyword_ranks(I.queries(spark, d), I.documents(spark, d).select("doc_id", "text"))


def _semantic(spark, d):
    return V.vector_topk(I.queries(spark, d), I.vectors(spark, d), keep=("doc_id",))


def _fused(spark, d):
    return fusion.rrf(_keyword(spark, d), _semantic(spark, d))


def _looked_up(spark, d, tags=False, fused=None):
    """A pool beside the catalog, as in the search. It is written, as it is read twice: only the documents in it are looked up."""
    pool = materialize(fusion.rerank_pool(_fused(spark, d) if fused is None else fused))
    return fusion.attach_metadata(pool, I.catalog(spark, d, tags=tags, only=pool))


@query("j5_fuse_ranks", S.build("SELECT query_id, doc_id, chunk_id, sem_rank, kw_rank FROM fused", "fused"))
def j5(spark, d):
    return fusion.fuse_ranks(_keyword(spark, d), _semantic(spark, d)).select("query_id", "doc_id", "chunk_id", big("sem_rank"), big("kw_rank"))


def _replies(spark, d):
    body = F.concat(F.lit('{"dimension_id": "Source Group", "category_name": "'), F.initcap("source"), F.lit('"}'))
    lang = F.concat(F.lit('{"dimension_id": "language", "category_name": " '), "lang", F.lit(' "}'))
    raw = (F.when(F.col("lang") == "en", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .when(F.col("lang") == "fr", F.concat(F.lit("```\n"), lang, F.lit("```"))).when(F.col("lang") == "de", body).otherwise("no idea"))
    return I.documents(spark, d).select("doc_id", raw.alias("raw"))


_SUGG = """(SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN 'source_group' ELSE 'language' END AS dimension_id,
    CASE WHEN lang IN ('en', 'de') THEN upper(substring(source, 1, 1)) || substring(source, 2) ELSE lang END AS category_name FROM documents WHERE lang <> 'es')"""


@query("f17_parse_suggestions", f"SELECT doc_id, dimension_id, category_name FROM {_SUGG}")
def f17(spark, d):
    return CL.parse_suggestions(_replies(spark, d))


@query("j6_merge_taxonomy", S.build(f"""
    SELECT 'dim' AS kind, dimension_id, display_name AS name FROM dims UNION ALL SELECT 'cat', dimension_id, CASE name WHEN 'fr' THEN 'old' ELSE name END FROM cats
    UNION ALL SELECT DISTINCT 'dim', 'source_group', 'Source Group' FROM {_SUGG} WHERE dimension_id = 'source_group'
    UNION ALL SELECT DISTINCT 'cat', dimension_id, category_name FROM {_SUGG}""", "dims", "cats"))
def j6(spark, d):
    cats = I.categories(spark, d).withColumn("name", F.when(F.col("name") == "fr", "old").otherwise(F.col("name")))
    dims, cats = CL.merge_taxonomy(I.dimensions(spark), cats, CL.parse_suggestions(_replies(spark, d)))
    return dims.select(F.lit("dim").alias("kind"), "dimension_id", F.col("display_name").alias("name")).union(
        cats.select(F.lit("cat"), "dimension_id", "name"))


# --- Aggregations -------------------------------------------------------------

@query("a1_document_counts", S.build("""
    SELECT count(*) FILTER (status = 'completed') AS "all", count(*) FILTER (status = 'completed' AND doc_type = 'syllabus') AS syllabus,
      count(*) FILTER (status = 'completed' AND doc_type = 'notes') AS notes, count(*) FILTER (status = 'completed' AND doc_type = 'assign') AS assign,
      count(*) FILTER (status = 'completed' AND coalesce(doc_type, 'other') = 'other') AS other,
      count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'failed') AS failed FROM base""", "base"))
def a1(spark, d):
    return C.document_counts(I.catalog(spark, d, tags=False))


@query("a2_tag_counts", S.build("SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM catalog WHERE status = 'completed') GROUP BY tag", "catalog"))
def a2(spark, d):
    return C.tag_counts(I.catalog(spark, d))


_LABEL = "coalesce(display_name, upper(substring(h.dimension_id, 1, 1)) || substring(h.dimension_id, 2)) AS label, coalesce(dim_order, 99) AS dim_order"
_HIER = S.build(f"""
    SELECT h.dimension_id, {_LABEL}, value, value_total, tag, n, place FROM (
      SELECT *, row_number() OVER (PARTITION BY dimension_id, value ORDER BY n DESC, tag) AS place, CAST(sum(n) OVER (PARTITION BY dimension_id, value) AS BIGINT) AS value_total FROM (
        SELECT dimension_id, value, tag, count(*) AS n FROM (SELECT dimension_id, value, unnest(tags) AS tag FROM classes WHERE status = 'completed') GROUP BY ALL)) h
    LEFT JOIN dims USING (dimension_id) WHERE place <= 20""", "classes", "dims")


@query("a3_tag_hierarchy", _HIER)
def a3(spark, d):
    return C.tag_hierarchy(I.catalog(spark, d), I.dimensions(spark)).select(
        "dimension_id", "label", "dim_order", "value", "value_total", "tag", "n", big("place"))


_PERSP = S.build(f"""SELECT h.dimension_id, {_LABEL}, value, n FROM (
    SELECT dimension_id, value, count(*) AS n FROM classes WHERE status = 'completed' GROUP BY ALL) h LEFT JOIN dims USING (dimension_id)""", "classes", "dims")


@query("a4_perspectives", _PERSP)
def a4(spark, d):
    return C.perspectives(I.catalog(spark, d, tags=False), I.dimensions(spark)).select("dimension_id", "label", "dim_order", "value", "n")


@query("a5_corpus_health", S.build("SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'processing') AS processing, "
                                   "(SELECT count(*) FROM embeddings) AS chunks FROM base", "base"))
def a5(spark, d):
    return C.corpus_health(I.catalog(spark, d, tags=False), I.vectors(spark, d))


@query("a6_pages_summary", S.build("""
    SELECT doc_id, count(*) AS page_count, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text,
      string_agg(text, chr(10) || chr(10) ORDER BY page) FILTER (r <= 3) AS sample FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS r FROM conv WHERE text <> '') GROUP BY doc_id""", "conv"))
def a6(spark, d):
    return paging.pages_summary(I.conversation_pages(spark, d)).withColumn("page_count", big("page_count"))


@query("a7_corpus_term_stats", S.build("SELECT term, count(*) AS df, (SELECT count(*) FROM dl) AS n_docs, round((SELECT avg(dl) FROM dl), 6) AS avgdl FROM postings GROUP BY term", "postings", "dl"))
def a7(spark, d):
    docs = I.documents(spark, d).select("doc_id", "text")
    c = lexical.corpus_stats(lexical.doc_stats(docs))
    return lexical.document_frequency(lexical.build_postings(docs, positions=False)).withColumns(
        {"n_docs": c.select("n_docs").scalar(), "avgdl": F.round(c.select("avgdl").scalar(), 6)})


@query("a8_tag_occurrence_totals", f"SELECT dimension_id, count(DISTINCT value) AS n_values, count(*) AS n_tags FROM ({_HIER}) GROUP BY 1")
def a8(spark, d):
    return C.tag_occurrence_totals(C.tag_hierarchy(I.catalog(spark, d), I.dimensions(spark)))


@query("t4_top_values", f"""SELECT dimension_id, value, n, place, greatest(total - 5, 0) AS more FROM (
    SELECT *, row_number() OVER (PARTITION BY dimension_id ORDER BY n DESC, value) AS place, count(*) OVER (PARTITION BY dimension_id) AS total FROM ({_PERSP})) WHERE place <= 5""")
def t4(spark, d):
    p = C.perspectives(I.catalog(spark, d, tags=False), I.dimensions(spark))
    return C.top_values(p).select("dimension_id", "value", "n", big("place"), "more")


@query("t3_newest_first", S.build("SELECT doc_id, CAST(row_number() OVER (ORDER BY upload_date DESC, doc_id) AS BIGINT) AS place, status FROM base", "base"))
def t3(spark, d):
    docs = I.catalog(spark, d, tags=False).select("doc_id", "status", "upload_date")
    return C.newest_places(docs).select("doc_id", big("place"), "status")


# --- Scalar functions ---------------------------------------------------------

def on_text(name: str, expr, sql: str, out: str = "value"):
    """A function of `documents.text` as a query."""
    @query(name, f"SELECT doc_id, {sql} AS {out} FROM documents")
    def run(spark, d):
        return I.documents(spark, d).select("doc_id", expr(F.col("text")).alias(out))


_F1 = f"regexp_replace({S.strip('x')}, '[ \\t\\x0b\\f\\r\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')"


@query("f1_normalize_text", f"SELECT doc_id, {S.strip(_F1)} AS value FROM (SELECT doc_id, regexp_replace(replace(replace(text, ' ', '  '), ',', '-'), '-\\n([a-z])', '\\1', 'g') AS x FROM documents)")
def f1(spark, d):
    src = F.replace(F.replace("text", F.lit(" "), F.lit(" ​ ")), F.lit(","), F.lit("—"))
    return I.documents(spark, d).select("doc_id", T.normalize_text(src, hooks.nfkc()).alias("value"))


@query("m6_nfkc", f"SELECT doc_id, {S.strip(_F1)} AS value FROM (SELECT doc_id, regexp_replace(text || ' 1 ffi', '-\\n([a-z])', '\\1', 'g') AS x FROM documents)")
def m6(spark, d):
    """Full-width letters, a ligature and a circled digit in every text that has them or not."""
    wide = F.translate("text", "aeT", "\uff41\uff45\uff34")
    src = F.concat(F.when(F.col("doc_id") % 2 == 0, wide).otherwise(F.col("text")), F.lit(" \u2460 \ufb03"))
    return I.documents(spark, d).select("doc_id", T.normalize_text(src, hooks.nfkc()).alias("value"))


@query("f2_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS value FROM pages")
def f2(spark, d):
    return I.table(spark, d, "pages").select("page_id", T.strip_tags("html").alias("value"))


@query("f3_split_sentences", f"SELECT doc_id, unnest(l) AS sentence, unnest(range(0, len(l))) AS pos FROM (SELECT doc_id, {S.chunk_sentences('text')} AS l FROM documents)")
def f3(spark, d):
    return I.documents(spark, d).select("doc_id", F.posexplode(T.split_sentences("text")).alias("pos", "sentence")).select("doc_id", "sentence", big("pos"))


_F4_TEXT = "'Course Overview: ' || regexp_replace(text, '\\n', ' ', 'g')"
_F4_PAT = K.OVERVIEW_PATTERN.replace("(?is)", "(?is)").replace("'", "''")


@query("f4_overview_sentence", f"""
    SELECT doc_id, coalesce(CASE WHEN length(s) > 20 AND length(s) < 200 THEN rtrim(s, '.') END, '') AS value FROM (
      SELECT doc_id, string_split(regexp_replace({S.collapse('f')}, '([.!?]){S.WS}+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))[1] AS s FROM (
        SELECT doc_id, regexp_extract(regexp_replace({_F4_TEXT}, '<[^>]+>', ' ', 'g'), '{_F4_PAT}', 1) AS f FROM documents))""")
def f4(spark, d):
    src = F.concat(F.lit("Course Overview: "), F.regexp_replace("text", "\n", " "))
    return I.documents(spark, d).select("doc_id", F.coalesce(T.overview_sentence(src), F.lit("")).alias("value"))


on_text("f5_fallback_summary", T.fallback_summary, S.fallback("text"))
on_text("f6_short_summary", T.short_summary, S.short("text"))

_LEAD = ("list_filter(list_transform(regexp_split_to_array(" + S.strip("text") + ", '[.!?]+'), lambda s: " + S.strip("s")
         + "), lambda s: length(s) >= 5 AND NOT regexp_matches(lower(s), '^(abstract|summary|contents):'))")


@query("f6b_lead_summary", f"""
    SELECT doc_id, CASE WHEN n > 0 THEN array_to_string(l[1:n], '. ') || '.' ELSE substring(text, 1, 100) END AS value FROM (
      SELECT doc_id, text, l, len(list_filter(range(1, len(l) + 1), lambda i: list_sum(list_transform(l[1:i], lambda s: len(regexp_split_to_array(s, '{S.WS}+')))) <= 20)) AS n
      FROM (SELECT doc_id, text, {_LEAD} AS l FROM documents))""")
def f6b(spark, d):
    return I.documents(spark, d).select("doc_id", T.lead_summary("text").alias("value"))


def _hits(pattern, x):
    return f"len(regexp_extract_all({x}, '(?i){pattern}'))"


@query("f7_key_insights", f"""
    WITH s AS (SELECT doc_id, unnest(l) AS s, unnest(range(0, len(l))) AS pos FROM (SELECT doc_id, {S.sentences(S.collapse('text'), 40)} AS l FROM documents)),
    x AS (SELECT *, 2 * {_hits(K.SCIENTIFIC_SIGNAL, 's')} + {_hits(K.POLICY_SIGNAL, 's')} AS score FROM s),
    y AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM x),
    z AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) - 1 AS place FROM y WHERE best = 0 OR score > 0)
    SELECT doc_id, place, {S.ellipsis('s', 300)} AS sentence FROM z WHERE place < 5""")
def f7(spark, d):
    return I.documents(spark, d).select("doc_id", F.posexplode(T.key_insights("text", 5)).alias("place", "sentence")).select("doc_id", big("place"), "sentence")


@query("t5_top_sentences", f"""
    WITH s AS (SELECT doc_id, unnest(l) AS s, unnest(range(0, len(l))) AS pos FROM (SELECT doc_id, {S.sentences(S.collapse("regexp_replace(text, ' (is|die|la) ', ' result ', 'g')"), 40)} AS l FROM documents)),
    x AS (SELECT *, 2 * {_hits(K.SCIENTIFIC_SIGNAL, 's')} + {_hits(K.POLICY_SIGNAL, 's')} AS score FROM s),
    y AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM x),
    z AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) - 1 AS place FROM y WHERE best = 0 OR score > 0)
    SELECT doc_id, place, {S.ellipsis('s', 300)} AS sentence FROM z WHERE place < 4""")
def t5(spark, d):
    signal = F.regexp_replace("text", " (is|die|la) ", " result ")
    return I.documents(spark, d).select("doc_id", F.posexplode(T.key_insights(signal, 4)).alias("place", "sentence")).select("doc_id", big("place"), "sentence")


@query("f7_document_insights", SQL["f7_key_insights"].replace("SELECT doc_id, place,", "SELECT doc_id, 'extracted' AS source, place,").replace(
    "WHERE place < 5", "WHERE place < 5 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1)"))
def f7b(spark, d):
    r = C.document_insights(I.catalog(spark, d, tags=False), I.documents(spark, d).select("doc_id", "text"))
    return r.select("doc_id", "source", F.posexplode("insights").alias("place", "sentence")).select("doc_id", "source", big("place"), "sentence")


_F8 = f"list_filter({S.sentences(S.collapse('x'), 30)}, lambda s: regexp_matches(s, '(?i){K.FINDING_SIGNAL}'))"


@query("f8_key_findings", f"""
    SELECT doc_id, array_to_string(list_transform((CASE WHEN len(h) > 0 THEN h ELSE f END)[1:3], lambda s: {S.ellipsis('s', 120)}), '|') AS value FROM (
      SELECT doc_id, {_F8} AS h, {S.sentences(S.collapse('x'), 40)} AS f FROM (
        SELECT doc_id, CASE WHEN lang = 'en' THEN regexp_replace(text, '\\bthe\\b', 'must', 'g') ELSE text END AS x FROM documents))""")
def f8(spark, d):
    src = F.when(F.col("lang") == "en", F.regexp_replace("text", r"(?U)\bthe\b", "must")).otherwise(F.col("text"))
    return I.documents(spark, d).select("doc_id", joined(T.key_findings(src)).alias("value"))


@query("f9_doc_type", S.build(f"SELECT doc_id, CASE WHEN lang = 'fr' THEN 'notes' ELSE {S.doc_type_of('tags')} END AS doc_type FROM catalog", "catalog"))
def f9(spark, d):
    cls = F.when(F.col("classifications.language")[0] == "fr", F.create_map(F.lit("doc_type"), F.array(F.lit("Lab Report")))).otherwise(
        F.create_map().cast("map<string,array<string>>"))
    return I.catalog(spark, d).select("doc_id", TG.doc_type("tags", cls).alias("doc_type"))


_KNOWN = S.in_list(K.SYLLABUS_TAGS + K.NOTES_TAGS + K.ASSIGN_TAGS)
_TERM = K.TERM_PATTERN
_LEVEL = "|".join(K.LEVEL_WORDS)


@query("f10_categorise_tags", S.build(f"""
    SELECT doc_id, array_to_string(list_filter(tags, lambda t: t NOT IN {_KNOWN} AND NOT regexp_matches(t, '{_TERM}') AND NOT regexp_matches(t, '{_LEVEL}')), '|') AS subject,
      array_to_string(list_filter(tags, lambda t: t IN {_KNOWN}), '|') AS doc_type,
      array_to_string(list_filter(tags, lambda t: t NOT IN {_KNOWN} AND NOT regexp_matches(t, '{_TERM}') AND regexp_matches(t, '{_LEVEL}')), '|') AS level,
      array_to_string(list_filter(tags, lambda t: t NOT IN {_KNOWN} AND regexp_matches(t, '{_TERM}')), '|') AS term FROM catalog""", "catalog"))
def f10(spark, d):
    c = TG.categorise_tags("tags")
    return I.catalog(spark, d).select("doc_id", *[joined(c[k]).alias(k) for k in ("subject", "doc_type", "level", "term")])


@query("f11_paginate_text", S.build("SELECT doc_id, page, text FROM pages WHERE text <> ''", "pages"))
def f11(spark, d):
    return I.document_pages(spark, d).select("doc_id", big("page"), "text")


_WB = "(SELECT doc_id, unnest(l) AS text, unnest(range(0, len(l))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query("f12_paginate_blocks", f"""
    WITH RECURSIVE b AS MATERIALIZED (SELECT doc_id, n, text, CASE WHEN {S.strip('text')} = '' THEN 0 ELSE len(regexp_split_to_array({S.strip('text')}, '{S.WS}+')) END AS w FROM {_WB}),
    f AS (SELECT doc_id, -1::BIGINT AS n, 1::BIGINT AS page, 0::BIGINT AS wc, 1::BIGINT AS nextpage FROM documents
      UNION ALL SELECT f.doc_id, b.n, nextpage, CASE WHEN wc + w >= 300 THEN 0 ELSE wc + w END, CASE WHEN wc + w >= 300 THEN nextpage + 1 ELSE nextpage END
      FROM f JOIN b ON b.doc_id = f.doc_id AND b.n = f.n + 1)
    SELECT f.doc_id, page, string_agg(text, chr(10) ORDER BY f.n) AS text FROM f JOIN b ON b.doc_id = f.doc_id AND b.n = f.n GROUP BY f.doc_id, page""")
def f12(spark, d):
    b = I.documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    return paging.paginate_blocks(b).select("doc_id", big("page"), "text")


@query("f13_cells_to_markdown", S.build("""
    SELECT doc_id, page, string_agg(t, chr(10) || chr(10) ORDER BY table_no) AS text FROM (
      SELECT doc_id, page, table_no, string_agg(l || CASE WHEN row_no = first THEN chr(10) || '| ' || array_to_string(list_transform(range(0, n), lambda i: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY row_no) AS t FROM (
        SELECT r.doc_id, r.page, r.table_no, r.row_no, first, n, '| ' || string_agg(coalesce(trim(replace(text, chr(10), ' ')), ''), ' | ' ORDER BY r.col_no) || ' |' AS l FROM (
          SELECT *, unnest(range(0, n)) AS col_no FROM (SELECT DISTINCT doc_id, page, table_no, row_no FROM cells)
          JOIN (SELECT doc_id, page, table_no, max(col_no) + 1 AS n, min(row_no) AS first, count(DISTINCT row_no) AS k FROM cells GROUP BY ALL) USING (doc_id, page, table_no) WHERE n >= 2 AND k >= 2) r
        LEFT JOIN cells c USING (doc_id, page, table_no, row_no, col_no) GROUP BY ALL) GROUP BY doc_id, page, table_no) GROUP BY doc_id, page""", "cells"))
def f13(spark, d):
    return paging.cells_to_markdown(I.cells(spark, d)).select("doc_id", big("page"), "text")


@query("f14_join_row_cells", S.build("""
    SELECT doc_id, page, table_no, row_no, string_agg(t, ' | ' ORDER BY c) AS text FROM (
      SELECT doc_id, page, table_no, row_no, trim(text) AS t, min(col_no) AS c FROM cells WHERE trim(coalesce(text, '')) <> '' GROUP BY ALL) GROUP BY ALL""", "cells"))
def f14(spark, d):
    return paging.join_row_cells(I.cells(spark, d)).select("doc_id", big("page"), big("table_no"), big("row_no"), "text")


@query("f15_highlight", """
    SELECT page_id, list_reduce(list_filter(list_transform(regexp_split_to_array(qy, '\\s+'), lambda w: regexp_replace(w, '[^a-zA-Z0-9]', '', 'g')), lambda w: length(w) > 1),
      lambda acc, w: regexp_replace(acc, '(' || w || ')', '<mark>\\1</mark>', 'gi'), esc) AS value FROM (
      SELECT page_id, 'the en=a, x ' || lower(substring(url, 8, 5)) AS qy, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS esc FROM pages)""")
def f15(spark, d):
    qy = F.concat(F.lit("the en=a, x "), F.lower(F.substring("url", 8, 5)))
    return I.table(spark, d, "pages").select("page_id", T.highlight("html", qy).alias("value"))


on_text("f16_title_case", lambda c: T.title_case(F.translate(c, "ß", "s")),
        "array_to_string(list_transform(regexp_extract_all(replace(text, 'ß', 's'), '\\p{L}+|\\P{L}+'), lambda r: upper(substring(r, 1, 1)) || lower(substring(r, 2))), '')")


@query("f18_is_syllabus", f"""
    SELECT doc_id, CAST(contains(x, 'syllabus') OR contains(x, 'course overview') OR contains(x, 'course description') AS INT) AS value FROM (
      SELECT doc_id, lower({S.FILENAME} || ' ' || regexp_replace(text, 'The ', 'Course overview ', 'g')) AS x FROM documents)""")
def f18(spark, d):
    df = I.named_text(spark, d).withColumn("text", F.regexp_replace("text", "The ", "Course overview "))
    return KW.is_syllabus(df).select("doc_id", F.col("is_syllabus").cast("int").alias("value"))


@query("f19_file_kind", f"SELECT doc_id, {S.EXT.format('f')} AS ext, CASE {S.EXT.format('f')} WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' ELSE 'other' END AS kind FROM (SELECT doc_id, upper({S.FILENAME}) AS f FROM documents)")
def f19(spark, d):
    return I.named_text(spark, d).withColumn("f", F.upper("filename")).select("doc_id", T.file_extension("f").alias("ext"), T.file_kind("f").alias("kind"))


@query("f20_entities", "SELECT doc_id, 0 AS companies, 0 AS dates, 0 AS project_names FROM documents")
def f20(spark, d):
    e = T.empty_entities()
    return I.documents(spark, d).select("doc_id", F.size(e["Companies"]).alias("companies"), F.size(e["Dates"]).alias("dates"), F.size(e["Project_Names"]).alias("project_names"))


@query("f21_model_summary", f"""
    SELECT doc_id, i AS input, CASE WHEN o <> '' THEN substring(o, 1, 180) ELSE '' END AS output FROM (
      SELECT doc_id, array_to_string(string_split({S.collapse('text')}, ' ')[1:600], ' ') AS i,
        string_split(regexp_replace({S.strip('text')}, '([.!?]){S.WS}', '\\1' || chr(1)), chr(1))[1] AS o FROM documents)""")
def f21(spark, d):
    return I.documents(spark, d).select("doc_id", T.model_summary_input("text", 600).alias("input"), F.coalesce(T.model_summary_output("text"), F.lit("")).alias("output"))


@query("m4_summarize", f"""
    SELECT doc_id, CASE WHEN lang = 'en' THEN {S.fallback('text')} ELSE substring(string_split(regexp_replace(array_to_string(string_split({S.collapse('text')}, ' ')[1:600], ' '), '([.!?]){S.WS}', '\\1' || chr(1)), chr(1))[1], 1, 180) END AS value FROM documents""")
def m4(spark, d):
    model = lambda c: F.when(F.col("lang") != "en", c)
    return I.documents(spark, d).select("doc_id", hooks.summarize(F.col("text"), model).alias("value"))


# --- Chunks and layout --------------------------------------------------------

@query("k1_chunk_pages", S.build("SELECT doc_id, page, part, text FROM chunks", "pages", recursive=S.chunk_ctes("SELECT doc_id, page, text FROM pages WHERE text <> ''")))
def k1(spark, d):
    return chunking.chunk_pages(I.document_pages(spark, d)).select("doc_id", big("page"), big("part"), "text")


@query("k1_chunk_conversations", S.build("SELECT doc_id, page, part, text FROM chunks", "conv", recursive=S.chunk_ctes("SELECT doc_id, page, text FROM conv")))
def k1b(spark, d):
    return chunking.chunk_pages(I.conversation_pages(spark, d)).select("doc_id", big("page"), big("part"), "text")


@query("k1_chunk_tabular", S.build(f"""
    SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY k) - 1 AS part, text FROM (
      SELECT doc_id, page, k, array_to_string(l[k + 1:k + 15], chr(10)) AS text FROM (
        SELECT doc_id, page, l, unnest(range(0, len(l), 13)) AS k FROM (SELECT doc_id, page, {S.lines('text')} AS l FROM evpages) WHERE {_tab('l')})) WHERE length(text) >= 20""", "evpages"))
def k1c(spark, d):
    pages = I.event_pages(spark, d).withColumn("l", T.text_lines("text")).filter(T.is_tabular("l")).drop("l")
    return chunking.chunk_pages(pages).select("doc_id", big("page"), big("part"), "text")


@query("w3_row_window_chunks", S.build(f"""
    SELECT doc_id, page, k // 13 AS part, array_to_string(l[k + 1:k + 15], chr(10)) AS text FROM (
      SELECT doc_id, page, l, unnest(range(0, len(l), 13)) AS k FROM (SELECT doc_id, page, {S.lines('text')} AS l FROM evpages))""", "evpages"))
def w3(spark, d):
    return I.event_pages(spark, d).select("doc_id", big("page"), F.posexplode(chunking.line_windows(T.text_lines("text"))).alias("part", "text")).select(
        "doc_id", "page", big("part"), "text")


@query("w4_cap_chunks", f"SELECT doc_id, page FROM (SELECT conv_id AS doc_id, turn + 1 AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 3")
def w4(spark, d):
    return chunking.cap_chunks(I.conversation_pages(spark, d).withColumn("part", F.lit(0)), 3).select("doc_id", big("page"))


@query("l1_reading_order", S.build(f"""
    SELECT doc_id, page, string_agg(t, chr(10) ORDER BY band, x0, block_no) AS text FROM (
      SELECT doc_id, page, x0, block_no, {S.strip('text')} AS t, trunc(y0 / greatest(5.0, avg(greatest(1.0, h)) OVER (PARTITION BY doc_id, page) * 0.75)) AS band
      FROM blocks WHERE block_type = 0 AND {S.strip('text')} <> '') GROUP BY doc_id, page""", "blocks"))
def l1(spark, d):
    return paging.reading_order(I.blocks(spark, d)).select("doc_id", big("page"), "text")


@query("w6_band_order", S.build(f"""
    SELECT doc_id, page, round(avg(greatest(1.0, h)), 6) AS height, count(*) AS n_blocks FROM blocks
    WHERE block_type = 0 AND {S.strip('text')} <> '' GROUP BY doc_id, page""", "blocks"))
def w6(spark, d):
    return paging.page_blocks(I.blocks(spark, d)).select("doc_id", big("page"), F.round("h", 6).alias("height"), F.size("b").cast("bigint").alias("n_blocks"))


@query("l2_detection_rows", """
    SELECT event_id // 400 AS doc_id, (event_id // 40) % 10 AS page, coalesce(string_agg(props || ' | u' || user_id || ' | ' || event_type, chr(10) ORDER BY event_id) FILTER (value >= 5), '') AS text
    FROM events GROUP BY 1, 2""")
def l2(spark, d):
    return paging.detection_rows(I.detections(spark, d)).select("doc_id", big("page"), F.coalesce("text", F.lit("")).alias("text"))


# --- Retrieval ----------------------------------------------------------------

@query("r1_build_postings", S.build("SELECT doc_id, term, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM (SELECT doc_id, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM doctok) GROUP BY ALL", "doctok"))
def r1(spark, d):
    return lexical.build_postings(I.documents(spark, d)).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query("r1_build_postings_stemmed")
def r1b(spark, d):
    return lexical.build_postings(I.documents(spark, d), hooks.porter(), positions=False)


@query("r2_query_terms", S.build("SELECT query_id, array_to_string(terms, '|') AS terms FROM qterms", "qterms"))
def r2(spark, d):
    return lexical.query_terms(I.queries(spark, d)).select("query_id", joined("terms").alias("terms"))


@query("r3_expand_query", S.build("""
    SELECT query_id, phrase FROM (SELECT e.doc_id AS query_id, phrase, row_number() OVER (PARTITION BY e.doc_id ORDER BY pos) AS r
      FROM e JOIN qraw ON query_id = doc_id WHERE contains(phrase, ' ') OR NOT list_contains(raw, phrase)) WHERE r <= 3""", "qraw",
    recursive=S.keyphrase_ctes("SELECT query_id AS doc_id, text FROM qs JOIN qraw USING (query_id) WHERE len(raw) >= 4", 4, "e")))
def r3(spark, d):
    return KW.expand_query(I.queries(spark, d))


@query("r4_bm25", S.build("SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM bm", "bm"))
def r4(spark, d):
    docs = I.documents(spark, d).select("doc_id", "text")
    items = materialize(lexical.match_items(lexical.query_terms(I.queries(spark, d))))
    s = lexical.bm25(items, *lexical.query_index(docs, items))
    return s.withColumn("bm25", F.round("bm25", 6))


@query("r4_bm25_phrases", S.build(f"""
    WITH tok AS (SELECT doc_id, unnest(t) AS a, unnest(t[2:] || ['']) AS b FROM doctok),
    qp AS (SELECT query_id, terms[1] || ' ' || terms[2] AS item, strip_accents(terms[1]) AS a, strip_accents(terms[2]) AS b FROM (
      SELECT query_id, raw AS terms FROM qraw WHERE len(raw) >= 2)),
    m AS (SELECT q.a || ' ' || q.b AS item, doc_id, count(*) AS tf FROM (SELECT DISTINCT a, b FROM qp) q JOIN tok USING (a, b) GROUP BY ALL),
    i AS (SELECT item, greatest(ln(((SELECT count(*) FROM dl) - count(*) + 0.5) / (count(*) + 0.5)), {K.BM25_IDF_FLOOR}) AS idf FROM m GROUP BY item)
    SELECT query_id, doc_id, round(idf * tf * {K.BM25_K1 + 1} / (tf + {K.BM25_K1} * (1 - {K.BM25_B} + {K.BM25_B} * dl / (SELECT avg(dl) FROM dl))), 6) AS bm25
    FROM qp JOIN m ON m.item = qp.a || ' ' || qp.b JOIN i ON i.item = m.item JOIN dl USING (doc_id)""".replace("WITH tok", "SELECT * FROM (WITH tok") + ")", "qraw", "doctok", "dl"))
def r4b(spark, d):
    docs = I.documents(spark, d).select("doc_id", "text")
    raw = I.queries(spark, d).select("query_id", F.filter(T.words("text"), lambda t: F.length(t) > 1).alias("w")).filter(F.size("w") >= 2)
    phrases = raw.select("query_id", F.array(F.array_join(F.slice("w", 1, 2), "_")).alias("terms"))
    items = materialize(lexical.match_items(phrases))
    s = lexical.bm25(items, *lexical.query_index(docs, items))
    return s.withColumn("bm25", F.round("bm25", 6))


@query("r4_bm25_stored_after_update", S.build("SELECT query_id, doc_id, kw_rank FROM kw", "kw"))
def r4c(spark, d):
    """Ranks of r4 from an index that first held other texts of a third of the documents and some foreign ones."""
    docs = I.documents(spark, d).select("doc_id", "text")
    post = lambda rows: lexical.build_postings(rows, positions=False, lengths=True)
    old = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("the old words "), F.reverse("text"))).otherwise(F.col("text")).alias("text"))
    old = old.where("doc_id % 9 <> 2").union(docs.where("doc_id % 50 = 0").select(-F.col("doc_id") - 1, "text"))
    path, none = shared_dir(spark), I.vectors(spark, d).select("chunk_id", "doc_id").where("chunk_id < 5")
    ST.write_index(none, none, post(old), path, buckets=32)
    new = docs.where("doc_id % 3 = 1 OR doc_id % 9 = 2")
    ST.update_index(spark, path, new.select("doc_id").union(old.where("doc_id < 0").select("doc_id")), {"postings": post(new)}, buckets=32)
    t = ST.read_index(spark, path)
    ranks = lexical.keyword_ranks(I.queries(spark, d), docs, postings=t["postings"], headers=t["headers"], parts=t["parts"])
    return ranks.select("query_id", "doc_id", big("kw_rank"))


@query("a7_stored_after_update", SQL["a7_corpus_term_stats"])
def a7b(spark, d):
    """A7 of an updated index, merged from its parts."""
    docs = I.documents(spark, d).select("doc_id", "text")
    post = lambda rows: lexical.build_postings(rows, positions=False, lengths=True)
    path, none = shared_dir(spark), I.vectors(spark, d).select("chunk_id", "doc_id").where("chunk_id < 5")
    ST.write_index(none, none, post(docs.where("doc_id % 4 > 0").withColumn("text", F.concat("text", F.lit(" tail")))), path, buckets=16)
    ST.update_index(spark, path, docs.select("doc_id"), {"postings": post(docs)}, buckets=16)
    t = ST.read_index(spark, path)
    df, totals = lexical.merged_stats(t["headers"], t["parts"])
    return df.withColumns({"n_docs": totals.select("n_docs").scalar(), "avgdl": F.round(totals.select("avgdl").scalar(), 6)})


@query("w1_rank_keyword", S.build("SELECT query_id, doc_id, kw_rank FROM kw", "kw"))
def w1(spark, d):
    return _keyword(spark, d).select("query_id", "doc_id", big("kw_rank"))


@query("r5_vector_topk", S.build("SELECT query_id, chunk_id, similarity, sem_rank FROM sem", "sem"))
def r5(spark, d):
    return V.vector_topk(I.queries(spark, d), I.vectors(spark, d)).withColumn("sem_rank", big("sem_rank"))


@query("w2_rank_semantic_by_blocks", S.build("SELECT query_id, chunk_id, similarity, sem_rank FROM sem", "sem"))
def w2(spark, d):
    return V.vector_topk(I.queries(spark, d), I.vectors(spark, d), ship_rows=12).withColumn("sem_rank", big("sem_rank"))


def _spoilt(rows, key):
    """Some vectors are null, of another length, or hold NaN, an infinity or null."""
    k, e, nan = F.col(key) % 11, F.col("embedding"), F.lit(float("nan")).cast("float")
    odd = (F.when(k == 1, F.lit(None)).when(k == 2, F.slice(e, 1, 63)).when(k == 3, F.concat(F.slice(e, 1, 63), F.array(nan)))
           .when(k == 4, F.concat(F.slice(e, 1, 63), F.array(F.lit(float("-inf")).cast("float"))))
           .when(k == 5, F.concat(F.array(F.lit(None).cast("float")), F.slice(e, 1, 63))).otherwise(e))
    return rows.withColumn("embedding", odd)


@query("r5_vector_topk_spoilt", S.build(f"""
    SELECT query_id, chunk_id, similarity, sem_rank FROM (SELECT query_id, chunk_id, round(greatest(0.0, s), 4) AS similarity,
      row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS sem_rank FROM sim WHERE chunk_id % 11 NOT BETWEEN 1 AND 5 AND query_id % 11 NOT BETWEEN 1 AND 5)
    WHERE sem_rank <= {K.SEMANTIC_TOP}""", "sim"))
def r5b(spark, d):
    return V.vector_topk(_spoilt(I.queries(spark, d), "query_id"), _spoilt(I.vectors(spark, d), "chunk_id")).withColumn("sem_rank", big("sem_rank"))


@query("r5_rejected_vectors", """
    SELECT CASE WHEN vec_id % 11 = 1 THEN 'no vector' WHEN vec_id % 11 = 2 THEN 'other length' ELSE 'null or not finite' END AS reason, count(*) AS n
    FROM embeddings WHERE vec_id % 11 BETWEEN 1 AND 5 GROUP BY 1""")
def r5c(spark, d):
    return V.rejected_vectors(_spoilt(I.vectors(spark, d), "chunk_id"), 64)


_HASH = """list_transform(range(0, 64), lambda b: CAST(len(list_filter(c, lambda x: x = b)) - len(list_filter(c, lambda x: x = b + 64)) AS DOUBLE))"""


def _hash_sql(table: str, key: str, text: str) -> str:
    return f"""SELECT {key}, e.i AS dim, round(e.x / CASE WHEN n > 0 THEN n ELSE 1 END, 6) AS value FROM (
      SELECT {key}, unnest(list_zip(range(0, 64), v), max_depth := 1) AS z, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (
        SELECT {key}, {_HASH} AS v FROM (
          SELECT {key}, list_transform({S.words(text)}, lambda t: CAST('0x' || substring(md5(t), 1, 2) AS INT) % 128) AS c FROM {table}))), LATERAL (SELECT z[1] AS i, z[2] AS x) e"""


@query("r6_encode_distinct", _hash_sql("benchmark", "item_id", "text"))
def r6(spark, d):
    e = V.encode_distinct(I.table(spark, d, "benchmark"), hooks.hash_encoder)
    return e.select("item_id", F.posexplode("embedding").alias("dim", "value")).select("item_id", big("dim"), F.round("value", 6).alias("value"))


@query("m1_hash_encoder", _hash_sql("(SELECT conv_id * 100 + turn AS id, text FROM conversations)", "id", "text"))
def m1(spark, d):
    c = spread(I.table(spark, d, "conversations"), "conv_id").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), hooks.hash_encoder("text").alias("v"))
    return c.select("id", F.posexplode("v").alias("dim", "value")).select("id", big("dim"), F.round("value", 6).alias("value"))


@query("r7_rrf", S.build("SELECT query_id, chunk_id, doc_id, kw_rank, sem_rank, score FROM fused", "fused"))
def r7(spark, d):
    return _fused(spark, d).select("query_id", "chunk_id", "doc_id", big("kw_rank"), big("sem_rank"), "score")


@query("t1_rerank_pool", S.build("SELECT query_id, chunk_id, fused_rank, score FROM pool", "pool"))
def t1(spark, d):
    return fusion.rerank_pool(_fused(spark, d)).select("query_id", "chunk_id", big("fused_rank"), "score")


_OVERLAP = f"round(len(list_intersect(list_distinct({S.words('q.text')}), list_distinct({S.words('x.text')}))) / len(list_distinct({S.words('q.text')})), 4)"


def _searchable(spark, d):
    """Vectors shown with their document's text."""
    return I.vectors(spark, d).join(I.documents(spark, d).select("doc_id", "text"), "doc_id", "left")


@query("r8_rerank", S.build(f"""
    SELECT query_id, chunk_id, ce_score, row_number() OVER (PARTITION BY query_id ORDER BY ce_score DESC NULLS LAST, fused_rank) AS rank FROM (
      SELECT h.query_id, h.chunk_id, h.fused_rank, CASE WHEN count(*) OVER (PARTITION BY h.query_id) > 1 THEN {_OVERLAP} END AS ce_score
      FROM hits h JOIN qs q USING (query_id) JOIN documents x USING (doc_id))""", "hits", "qs"))
def r8(spark, d):
    hits = _looked_up(spark, d)
    hits = hits.join(I.documents(spark, d).select("doc_id", "text"), "doc_id").join(
        I.queries(spark, d).select("query_id", F.col("text").alias("query")), "query_id")
    return fusion.rerank(hits).select("query_id", "chunk_id", "ce_score", big("rank"))


@query("r9_hybrid_search", S.build("""
    SELECT query_id, rank, chunk_id, doc_id, page, score, similarity, filename, summary, array_to_string(tags, '|') AS tags FROM (
      SELECT h.*, v.page, c.tags, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS rank
      FROM hits h JOIN vecs v USING (chunk_id) JOIN catalog c ON c.doc_id = h.doc_id) WHERE rank <= 5""", "hits", "vecs", "catalog"))
def r9(spark, d):
    hits = PS.hybrid_search(I.queries(spark, d), I.catalog(spark, d), I.documents(spark, d).select("doc_id", "text"), I.vectors(spark, d))
    return hits.select("query_id", big("rank"), "chunk_id", "doc_id", big("page"), "score", "similarity", "filename", "summary", joined("tags").alias("tags"))


_SCORES = "CASE WHEN length(x.text) % 3 > 0 THEN -(length(x.text) % 7) / 2.0 END"


@query("r8_rerank_scores", S.build(f"""
    SELECT query_id, chunk_id, coalesce(ce_score, 99) AS ce_score, row_number() OVER (PARTITION BY query_id ORDER BY ce_score DESC NULLS LAST, fused_rank) AS rank FROM (
      SELECT h.query_id, h.chunk_id, h.fused_rank, CASE WHEN count(*) OVER (PARTITION BY h.query_id) > 1 THEN {_SCORES} END AS ce_score
      FROM hits h JOIN documents x USING (doc_id))""", "hits"))
def r8b(spark, d):
    """A scorer whose scores are not positive and sometimes missing."""
    hits = _looked_up(spark, d)
    hits = hits.join(I.documents(spark, d).select("doc_id", "text"), "doc_id").withColumn("query", F.lit(""))
    score = lambda q, t: F.when(F.length(t) % 3 > 0, -(F.length(t) % 7) / F.lit(2.0))
    return fusion.rerank(hits, score).select("query_id", "chunk_id", F.coalesce("ce_score", F.lit(99.0)).alias("ce_score"), big("rank"))


def _stored(spark, d, docs):
    """A written index of the documents; its path."""
    path = shared_dir(spark)
    vecs = I.vectors(spark, d)
    ST.write_index(vecs.select("chunk_id", "doc_id", "page"), vecs.select("chunk_id", "doc_id", "page", "embedding"),
                   lexical.build_postings(docs, positions=False, lengths=True), path, buckets=8)
    return path


def _read_stored(spark, path):
    t = ST.read_index(spark, path)
    return {"vectors": t["vectors"], "postings": t["postings"], "headers": t["headers"], "parts": t["parts"]}


@query("r9_hybrid_search_stored", SQL["r9_hybrid_search"])
def r9c(spark, d):
    """The search of r9 over a stored index: no text is tokenised, buckets out of reach are skipped."""
    docs = I.documents(spark, d).select("doc_id", "text")
    hits = PS.hybrid_search(I.queries(spark, d), I.catalog(spark, d), docs, **_read_stored(spark, _stored(spark, d, docs)))
    return hits.select("query_id", big("rank"), "chunk_id", "doc_id", big("page"), "score", "similarity", "filename", "summary", joined("tags").alias("tags"))


def _quality_sql(name, ranks):
    return f"""SELECT '{name}' AS method, count(*) AS n_queries, round(avg(CASE WHEN best = 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN best <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_n,
      round(avg(CASE WHEN best <= 10 THEN 1.0 / best ELSE 0 END), 6) AS mrr FROM (SELECT query_id, min(rank) AS best FROM (SELECT DISTINCT q.query_id, x.doc_id FROM qs q JOIN documents x ON contains(x.text, q.text)) LEFT JOIN ({ranks}) USING (query_id, doc_id) GROUP BY 1)"""


@query("q1_retrieval_quality", S.build(f"""
    {_quality_sql('keyword', 'SELECT query_id, doc_id, kw_rank AS rank FROM kw')} UNION ALL
    {_quality_sql('semantic', 'SELECT query_id, doc_id, sem_rank AS rank FROM sem')} UNION ALL
    {_quality_sql('hybrid', 'SELECT query_id, doc_id, fused_rank AS rank FROM hits')}""", "kw", "sem", "hits", "qs"))
def q1(spark, d):
    """Recall and reciprocal rank of documents that hold the query's text."""
    relevant = materialize(Q.verbatim_documents(I.queries(spark, d), I.documents(spark, d)))
    keyword, semantic = _keyword(spark, d), _semantic(spark, d)
    pool = _looked_up(spark, d, fused=fusion.rrf(keyword, semantic))
    out = None
    for name, rows, rank in (("keyword", keyword, "kw_rank"), ("semantic", semantic, "sem_rank"), ("hybrid", pool, "fused_rank")):
        one = Q.retrieval_quality(rows.select("query_id", "doc_id", F.col(rank).alias("rank")), relevant).withColumn("method", F.lit(name))
        out = one if out is None else out.union(one)
    return out


@query("t2_top_hits_of_50", S.build("""SELECT query_id, rank, chunk_id FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sem_rank) AS rank
    FROM (SELECT query_id, chunk_id, min(sem_rank) AS sem_rank, min_by(score, sem_rank) AS score FROM fused GROUP BY 1, 2)) WHERE rank <= 50""", "fused"))
def t2b(spark, d):
    """A limit beyond the reranker's usual bound."""
    return fusion.top_hits(fusion.fused_order(fusion.rerank_pool(_fused(spark, d), 50)), 50).select("query_id", big("rank"), "chunk_id")


@query("t2_top_hits", S.build("SELECT query_id, rank, chunk_id FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS rank FROM hits) WHERE rank <= 3", "hits"))
def t2(spark, d):
    hits = _looked_up(spark, d)
    return fusion.top_hits(fusion.fused_order(hits), 3).select("query_id", big("rank"), "chunk_id")


@query("p13_present_hits", S.build("SELECT query_id, chunk_id, CAST(round(similarity * 100) AS INT) AS relevancy, array_to_string(c.tags[1:3], '|') AS tags FROM hits h JOIN catalog c USING (doc_id)", "hits", "catalog"))
def p13(spark, d):
    hits = _looked_up(spark, d, tags=True)
    return fusion.present_hits(hits).select("query_id", "chunk_id", "relevancy", joined("shown_tags").alias("tags"))


@query("r9_hybrid_search_from_text")
def r9b(spark, d):
    """Everything on: chunks from the documents, default encoder, stems, phrases, reranker."""
    docs = I.named_text(spark, d)
    chunks = chunking.number_chunks(chunking.chunk_pages(paging.paginate_text(docs)))
    vecs = materialize(chunks.select("chunk_id", "doc_id", "page", "text", hooks.hash_encoder("text").alias("embedding")))
    qs = I.queries(spark, d).select("query_id", "text")
    cat = I.catalog(spark, d, tags=False)
    hits = PS.hybrid_search(qs, cat, docs.select("doc_id", "text"), vecs, encoder=hooks.hash_encoder,
                            stemmer=hooks.porter(), expand=True, scorer=hooks.overlap_scorer)
    return hits.select("query_id", "rank", "chunk_id", "doc_id", "score", "ce_score")


# --- Keywords and classification ----------------------------------------------

_DOCS = "SELECT doc_id, text FROM documents"


@query("k2_keyphrases", S.build("SELECT doc_id, pos, phrase, round(score, 6) AS score FROM kp", recursive=S.keyphrase_ctes(_DOCS, 9)))
def k2(spark, d):
    return KW.keyphrases(I.documents(spark, d), 9).select("doc_id", big("pos"), "phrase", F.round("score", 6).alias("score"))


_PLAIN = "regexp_full_match({0}, '[A-Za-z][a-z]{{3,}}')"


@query("k3_semantic_candidates", f"""
    WITH t AS (SELECT conv_id * 100 + turn AS doc_id, regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g') AS text FROM conversations),
    w AS (SELECT doc_id, text, list_filter(regexp_extract_all(text, '{S.WORD}'), lambda x: {_PLAIN.format('x')}) AS w FROM t),
    c AS (SELECT doc_id, phrase, min((kind, spot)) AS k FROM (
      SELECT doc_id, 0 AS kind, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY phrase) AS spot FROM (SELECT DISTINCT doc_id, unnest(list_filter(w, lambda x: lower(x) NOT IN {S.STOP})) AS phrase FROM w)
      UNION ALL SELECT doc_id, 1, a || ' ' || b, spot FROM (SELECT doc_id, unnest(w) AS a, unnest(w[2:]) AS b, unnest(range(0, len(w))) AS spot FROM w)
        WHERE b IS NOT NULL AND lower(a) NOT IN {S.STOP} AND lower(b) NOT IN {S.STOP}) GROUP BY ALL),
    p AS (SELECT phrase, v FROM {S.hashed('phrase', 'SELECT DISTINCT phrase, phrase AS text FROM c')}),
    s AS (SELECT c.doc_id, k, phrase, {S.hash_cosine('h.v', 'p.v')} AS score FROM c JOIN p USING (phrase) JOIN {S.hashed('doc_id', 'SELECT * FROM t')} h ON h.doc_id = c.doc_id)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) - 1 AS pos, phrase, round(score, 6) AS score FROM s WHERE score > {KW.SEMANTIC_FLOOR}""")
def k3(spark, d):
    """On conversation turns: one candidate list a turn."""
    turns = spread(I.table(spark, d, "conversations"), "conv_id").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text")
    return KW.semantic_candidates(turns, hooks.hash_encoder).select("doc_id", big("pos"), "phrase", F.round("score", 6).alias("score"))


@query("k4_tf_terms", f"""
    WITH w AS (SELECT doc_id, list_filter({S.words('text')}, lambda t: length(t) > 1 AND t NOT IN {S.STOP}) AS w FROM documents),
    p AS (SELECT doc_id, unnest(w) AS phrase FROM w UNION ALL SELECT doc_id, a || ' ' || b FROM (SELECT doc_id, unnest(w) AS a, unnest(w[2:]) AS b FROM w) WHERE b IS NOT NULL)
    SELECT doc_id, r - 1 AS pos, phrase, tf, round(1 + ln(tf), 6) AS weight FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, phrase) AS r FROM (SELECT doc_id, phrase, count(*) AS tf FROM p GROUP BY ALL)) WHERE r <= 50""")
def k4(spark, d):
    return KW.tf_terms(I.documents(spark, d)).select("doc_id", big("pos"), "phrase", "tf", F.round("weight", 6).alias("weight"))


@query("k5_frequent_words", S.build("SELECT doc_id, pos, phrase, tf FROM freq WHERE pos < 30 AND tf >= 2", "freq"))
def k5(spark, d):
    return KW.frequent_words(I.documents(spark, d)).select("doc_id", big("pos"), "phrase", "tf")


@query("k6_content_keywords", S.build("SELECT doc_id, pos, tag FROM ck", recursive=S.content_ctes(_DOCS, 5)))
def k6(spark, d):
    return KW.content_keywords(I.documents(spark, d), 5).select("doc_id", big("pos"), "tag")


@query("k7_document_tags", S.build("SELECT doc_id, tags FROM dt", "cats", recursive=S.tags_ctes(_DOCS)))
def k7(spark, d):
    t = KW.document_tags(I.documents(spark, d), CL.label_union(I.categories(spark, d)))
    return t.select("doc_id", joined("tags").alias("tags"))


@query("k7_rule_based_tags", S.build(f"""
    SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(coalesce(t, []) || CASE WHEN contains(lower({S.FILENAME} || ' ' || text), 'syllabus') THEN ['Syllabus'] ELSE [] END)), '|'), '') AS tags
    FROM documents LEFT JOIN (SELECT doc_id, list(tag) AS t FROM ck GROUP BY 1) USING (doc_id)""", recursive=S.content_ctes(_DOCS, 3)))
def k7b(spark, d):
    return KW.rule_based_tags(I.named_text(spark, d)).select("doc_id", joined("tags").alias("tags"))


@query("k8_clean_tags", f"""
    WITH r AS (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda t: {S.strip('t')}), lambda t: t <> '' AND lower(t) NOT IN {S.in_list(K.GENERIC_TAGS)})[1:src % 8] AS k,
      ['Document A', lang, source, 'Extra'] AS fb FROM (SELECT *, {S.SRC} AS src FROM documents))
    SELECT doc_id, array_to_string(CASE WHEN len(k) < 2 THEN fb WHEN len(k) < 3 THEN list_concat(k, list_filter(fb, lambda t: NOT list_contains(k, t))[1:3])[1:5] ELSE k[1:6] END, '|') AS tags FROM r""")
def k8(spark, d):
    raw = F.concat(F.array(F.lit(" General "), F.lit("")), F.slice(
        F.filter(F.transform(F.split("text", " "), T.strip), lambda t: (t != "") & ~F.lower(t).isin(K.GENERIC_TAGS)),
        1, F.substring("source", 4, 9).cast("int") % 8))
    fb = F.array(F.lit("Document A"), "lang", "source", F.lit("Extra"))
    return I.documents(spark, d).select("doc_id", joined(TG.clean_tags(raw, fb)).alias("tags"))


@query("c1_classify", S.build("SELECT doc_id, dimension_id, labels FROM topic", "topic"))
def c1(spark, d):
    r = CL.classify(I.doc_vectors(spark, d), I.label_dims(spark), I.label_vectors(spark, d))
    return r.select("doc_id", F.explode("classifications").alias("dimension_id", "l")).select("doc_id", "dimension_id", joined("l").alias("labels"))


@query("c2_classify_with", S.build(f"""
    WITH s AS (SELECT doc_id, dimension_id, name, is_multi_label, least(1.0, round(len(regexp_extract_all(lower(text), lower(name))) / 10.0, 4)) AS sc
      FROM documents, (SELECT c.dimension_id, name, is_multi_label FROM cats c JOIN dims USING (dimension_id)))
    SELECT doc_id, dimension_id, array_to_string(list(name ORDER BY sc DESC, name), '|') AS labels FROM s WHERE is_multi_label AND sc > {K.MULTI_LABEL_THRESHOLD} GROUP BY 1, 2
    UNION ALL SELECT doc_id, dimension_id, name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, dimension_id ORDER BY sc DESC, name) AS r FROM s WHERE NOT is_multi_label AND sc > {K.SINGLE_LABEL_THRESHOLD}) WHERE r = 1
    """.replace("WITH s", "SELECT * FROM (WITH s") + ")", "cats", "dims"))
def c2(spark, d):
    r = CL.classify_with(I.documents(spark, d), I.dimensions(spark), I.categories(spark, d), hooks.label_scorer)
    return r.select("doc_id", F.explode("classifications").alias("dimension_id", "l")).select("doc_id", "dimension_id", joined("l").alias("labels"))


def _classes_of(c):
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), joined(e["value"]))), ";")


@query("m7_document_metadata", S.build(f"""
    SELECT doc_id, {S.fallback('text')} AS summary, coalesce(dt.tags, '') AS tags,
      array_to_string(list_transform((CASE WHEN len(hit) > 0 THEN hit ELSE long END)[1:3], lambda s: {S.ellipsis('s', 120)}), '|') AS key_findings, coalesce(cl.l, '') AS classifications
    FROM (SELECT *, {_F8.replace('(x)', '(text)').replace('(x,', '(text,')} AS hit, {S.sentences(S.collapse('text'), 40)} AS long FROM documents) LEFT JOIN dt USING (doc_id)
    LEFT JOIN (SELECT doc_id, string_agg(dimension_id || '=' || labels, ';' ORDER BY dimension_id) AS l FROM (
      SELECT doc_id, dimension_id, string_agg(name, '|' ORDER BY name) AS labels FROM hl WHERE is_multi_label AND s > {K.MULTI_LABEL_THRESHOLD} GROUP BY 1, 2
      UNION ALL SELECT doc_id, dimension_id, name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, dimension_id ORDER BY s DESC, name) AS r FROM hl WHERE NOT is_multi_label AND s > {K.SINGLE_LABEL_THRESHOLD}) WHERE r = 1) GROUP BY 1) cl USING (doc_id)""",
    "cats", "dims", recursive=S.tags_ctes(_DOCS) + f""",
    hl AS (SELECT h.doc_id, dimension_id, name, is_multi_label, {S.hash_cosine('h.v', 'n.v')} AS s FROM {S.hashed('doc_id', _DOCS)} h,
      (SELECT c.dimension_id, c.name, is_multi_label, v FROM cats c JOIN dims USING (dimension_id) JOIN {S.hashed('name', 'SELECT DISTINCT name, name AS text FROM cats')} USING (name)) n)"""))
def m7(spark, d):
    m = PI.document_metadata(I.named_text(spark, d), I.dimensions(spark), I.categories(spark, d))
    return m.select("doc_id", "summary", joined("tags").alias("tags"), joined("key_findings").alias("key_findings"),
                    _classes_of("classifications").alias("classifications"))


# --- Maintenance --------------------------------------------------------------

@query("u1_upsert", "SELECT doc_id, 0::BIGINT - quality AS n FROM labels UNION ALL SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u1(spark, d):
    new = I.table(spark, d, "labels").select("doc_id", (-F.col("quality")).cast("bigint").alias("n"))
    return U.upsert(I.documents(spark, d).select("doc_id", F.col("n_chars").alias("n")), new)


@query("u2_delete_documents", S.build("""
    SELECT 'catalog' AS tbl, doc_id, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 2
    UNION ALL SELECT 'vectors', doc_id, count(*) FROM vecs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 2""", "vecs"))
def u2(spark, d):
    out = U.delete_documents({"catalog": I.documents(spark, d).select("doc_id"), "vectors": I.vectors(spark, d).select("doc_id")},
                             I.table(spark, d, "labels").filter("toxic = 1"))
    one = lambda n: out[n].groupBy("doc_id").agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), "doc_id", "n")
    return one("catalog").union(one("vectors"))


@query("u3_reset_corpus", S.build("SELECT 'catalog' AS tbl, 0::BIGINT AS n UNION ALL SELECT 'vectors', 0 UNION ALL SELECT 'categories', (SELECT count(*) FROM cats)", "cats"))
def u3(spark, d):
    out = U.reset_corpus({"catalog": I.documents(spark, d), "vectors": I.vectors(spark, d), "categories": I.categories(spark, d)})
    one = lambda n: out[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("tbl"), "n")
    return one("catalog").union(one("vectors")).union(one("categories"))


@query("u5_retag", S.build(f"""
    SELECT b.doc_id, CASE WHEN {_NEEDS.replace('summary', 'b.summary').replace('source', 'b.source')} THEN array_to_string(list_sort(list_distinct(coalesce(t.l, []))), '|')
        ELSE 'Kept|General' END AS tags, b.summary
    FROM base b LEFT JOIN (SELECT doc_id, list(tag) || max(CASE WHEN contains(lower(filename || ' ' || text), 'syllabus') THEN ['Syllabus'] ELSE []::VARCHAR[] END) AS l
      FROM ck JOIN base USING (doc_id) GROUP BY 1) t USING (doc_id)""", "base", recursive=S.content_ctes(_DOCS, 3)))
def u5(spark, d):
    new, _ = U.retag(_untagged(spark, d), I.documents(spark, d).select("doc_id", "text"))
    return new.select("doc_id", joined("tags").alias("tags"), "summary")


@query("u6_reclassify", S.build(f"""
    SELECT b.doc_id, coalesce(c.l, '') AS classes, coalesce(t.tags, '') AS tags, {S.short('b.text')} AS summary FROM base b
    LEFT JOIN (SELECT doc_id, string_agg(dimension_id || '=' || labels, ';' ORDER BY dimension_id) AS l FROM topic GROUP BY 1) c USING (doc_id)
    LEFT JOIN dt t USING (doc_id)
    WHERE b.status = 'completed' AND b.lang <> 'en' AND {S.strip('b.text')} <> ''""", "base", "topic", recursive=S.tags_ctes(_DOCS, labels=f"SELECT unnest({S.words('text')}) AS label FROM benchmark")))
def u6(spark, d):
    def by_vector(todo):
        return CL.classify(I.doc_vectors(spark, d).join(todo, "doc_id", "left_semi"), I.label_dims(spark), I.label_vectors(spark, d))

    _, changes = U.reclassify(_unclassified(spark, d).drop("text"), I.documents(spark, d).select("doc_id", "text"),
                              _some_labels(spark, d), by_vector, signature="s2")
    classes = F.array_join(F.transform(F.map_entries("classifications"), lambda e: F.concat(e["key"], F.lit("="), joined(e["value"]))), ";")
    return changes.select("doc_id", classes.alias("classes"), joined("tags").alias("tags"), "summary")


# --- Streaming ----------------------------------------------------------------

def _stream(spark, d, name):
    return spark.readStream.schema(I.table(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")


def _run(start):
    run = start()
    run.awaitTermination()
    if run.exception():
        raise run.exception()


@query("x1_ingest_stream", S.build(f"""
    SELECT b.doc_id, CASE WHEN n IS NULL THEN 'failed' ELSE 'completed' END AS status, coalesce(n, 0) AS page_count, coalesce(c, 0) AS n_chunks
    FROM base b LEFT JOIN (SELECT doc_id, count(*) AS n FROM pages WHERE text <> '' GROUP BY 1) USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS c FROM chunks GROUP BY 1) USING (doc_id)""", "base", "pages",
    recursive=S.chunk_ctes("SELECT doc_id, page, text FROM pages WHERE text <> ''")))
def x1(spark, d):
    src = _stream(spark, d, "documents").select(
        "doc_id", I.filename().alias("filename"), F.octet_length("text").cast("bigint").alias("file_size_bytes"),
        F.timestamp_seconds(F.col("doc_id")).alias("upload_date"), "text")
    out, cp = shared_dir(spark), shared_dir(spark)
    _run(lambda: SI.ingest_stream(src, out, cp, I.dimensions(spark), I.categories(spark, d)))
    t = SI.read_tables(spark, out)
    n = t["chunks"].groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return t["catalog"].join(n, "doc_id", "left").select("doc_id", "status", big("page_count"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


@query("x1_failing_hook", """
    SELECT doc_id, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status, CASE WHEN bad THEN 'ValueError: cannot encode' ELSE '' END AS error_message FROM (
      SELECT doc_id, text, doc_id % 7 = 3 AS bad FROM documents) WHERE length(text) >= 60 AND regexp_matches(text, '[.!?]')""")
def x1b(spark, d):
    """An encoder that raises on some texts: their documents fail, with its message, and are in no other table."""
    def vector(text):
        if "☃" in text:
            raise ValueError("cannot encode")
        return [1.0, float(len(text))]

    docs = I.documents(spark, d).where((F.length("text") >= 60) & F.col("text").rlike("[.!?]")).select(
        "doc_id", I.filename().alias("filename"), F.octet_length("text").cast("bigint").alias("file_size_bytes"), F.timestamp_seconds(F.col("doc_id")).alias("upload_date"),
        F.when(F.col("doc_id") % 7 == 3, F.concat("text", F.lit(" ☃ here, ☃ there and ☃ once more in one of the last sentences, ☃."))).otherwise(F.col("text")).alias("text"))
    t = PI.ingest(docs, I.dimensions(spark), I.categories(spark, d), PI.IngestOptions(encoder=hooks.guarded(vector, "array<double>")))
    gone = t["catalog"].where("status = 'failed'").select("doc_id")
    left = [t[n].join(gone, "doc_id", "left_semi").select("doc_id") for n in ("doc_text", "pages", "chunks", "vectors", "postings")]
    none = left[0].union(left[1]).union(left[2]).union(left[3]).union(left[4]).select("doc_id", F.lit("still there").alias("status"), F.lit("").alias("error_message"))
    return t["catalog"].select("doc_id", "status", F.coalesce("error_message", F.lit("")).alias("error_message")).union(none)


_LASTP = S.build("SELECT doc_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, step, pct FROM lastp", "lastp")


def _ts(c="ts"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")


@query("x2_step_percent", """
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN 5 + CAST(floor((event_id % 40) / greatest(event_id % 41, 1) * 60) AS INT) WHEN 1 THEN 65 WHEN 2 THEN 70 WHEN 3 THEN 76 WHEN 4 THEN 93 ELSE 0 END AS pct FROM events""")
def x2c(spark, d):
    step = F.element_at(F.array(*[F.lit(x) for x in ("parsing", "ai_tagging", "chunking", "embedding", "saving", "queued")]), (F.col("event_id") % 6 + 1).cast("int"))
    return I.table(spark, d, "events").select("event_id", SP.step_percent(step, F.col("event_id") % 40, F.col("event_id") % 41).alias("pct"))


@query("x2_latest_progress", _LASTP)
def x2(spark, d):
    return SP.latest_progress(I.progress(spark, d)).select("doc_id", _ts(), "step", "pct")


def _progress_stream(spark, d):
    return _stream(spark, d, "events").select(
        F.col("user_id").alias("doc_id"), "ts", F.col("event_type").alias("step"), F.floor("value").cast("int").alias("pct"), F.col("props").alias("detail"))


@query("x2_latest_progress_stream", _LASTP)
def x2b(spark, d):
    out, cp = shared_dir(spark), shared_dir(spark)
    _run(lambda: SP.write_latest(SP.latest_progress(_progress_stream(spark, d)), out, cp, trigger={"availableNow": True}))
    return SP.read_latest(spark, out).select("doc_id", _ts(), "step", "pct")


_END = "(SELECT max(ts) FROM lastp)"


@query("x3_silent_documents", S.build(f"SELECT doc_id, 'failed' AS status FROM lastp WHERE ts < {_END} - INTERVAL 2 HOUR", "lastp"))
def x3(spark, d):
    p = I.progress(spark, d)
    return SP.silent_documents(p, p.agg(F.max("ts")).scalar()).select("doc_id", "status")


@query("x3_track_progress_stream", """
    WITH m AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
    l AS (SELECT doc_id, ts, step, pct FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, step DESC, pct DESC) AS r FROM (
      SELECT user_id AS doc_id, ts, CASE WHEN event_id % 9 = 0 THEN 'completed' ELSE event_type END AS step, CAST(floor(value) AS INT) AS pct FROM events, m
      WHERE user_id % 3 <> 0 OR ts <= lo + (hi - lo) / 2)) WHERE r = 1)
    SELECT doc_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, step, pct, CASE WHEN step IN ('completed', 'failed') THEN step
      WHEN ts + INTERVAL 4 HOUR < (SELECT max(ts) FROM l) THEN 'failed' ELSE 'processing' END AS status FROM l""")
def x3b(spark, d):
    """A third of the documents falls silent half-way; every ninth record says that its document is done."""
    lo, hi = I.table(spark, d, "events").agg(F.min("ts"), F.max("ts")).first()
    src = _stream(spark, d, "events").where((F.col("user_id") % 3 != 0) | (F.col("ts") <= F.lit(lo + (hi - lo) / 2))).select(
        F.col("user_id").alias("doc_id"), "ts", F.when(F.col("event_id") % 9 == 0, "completed").otherwise(F.col("event_type")).alias("step"),
        F.floor("value").cast("int").alias("pct"))
    out, cp = shared_dir(spark), shared_dir(spark)
    _run(lambda: SP.write_latest(SP.track_progress(src), out, cp, mode="update", trigger={"availableNow": True}))
    seen = spark.read.parquet(out)
    last = seen.groupBy("doc_id").agg(F.max_by(F.struct("ts", "step", "pct", "status"), F.struct("ts", "batch")).alias("r"))
    return last.select("doc_id", _ts("r.ts"), F.col("r.step").alias("step"), F.col("r.pct").alias("pct"), F.col("r.status").alias("status"))


def _live(spark, rounds):
    """Runs the live tables over the given catalog rows, one run of the stream after the other."""
    src, out, cp = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    for rows in rounds:
        rows.select("doc_id", "updated", "status", "doc_type", "tags").write.mode("append").parquet(src)
        stream = spark.readStream.schema("doc_id long, updated timestamp, status string, doc_type string, tags array<string>").parquet(src)
        _run(lambda: LV.write_live(stream, out, cp, trigger={"availableNow": True}))
    return out


@query("x4_live_tags_stream", "SELECT event_type AS tag, count(*) AS n FROM events GROUP BY 1")
def x4(spark, d):
    """Every event is a document that is first tagged otherwise, then as its type says; some come late."""
    e = I.table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("updated"), F.lit("completed").alias("status"),
                                           F.lit(None).cast("string").alias("doc_type"), F.array("event_type").alias("tags"))
    before = e.withColumns({"updated": F.col("updated") - F.expr("interval 1 hour"), "tags": F.array(F.lit("old"), F.concat(F.lit("x"), F.col("tags")[0]))})
    return LV.live_tags(spark, _live(spark, [before.where("doc_id % 3 > 0"), e, before.where("doc_id % 3 < 2")]))


@query("x4_live_counts_stream", """SELECT count(*) FILTER (lang = 'en') AS "all", count(*) FILTER (lang = 'en' AND n_chars > 2000) AS syllabus, 0::BIGINT AS notes, 0::BIGINT AS assign,
    count(*) FILTER (lang = 'en' AND n_chars <= 2000) AS other, count(*) FILTER (lang = 'fr') AS processing, count(*) FILTER (lang NOT IN ('en', 'fr')) AS failed
    FROM documents WHERE doc_id % 11 <> 4""")
def x4b(spark, d):
    """Documents arrive as processing, then with their outcome; some change their kind, some are deleted."""
    docs = I.documents(spark, d).select(
        "doc_id", F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("updated"), F.lit("processing").alias("status"),
        F.lit(None).cast("string").alias("doc_type"), F.array(F.lit("t")).alias("tags"), "lang", "n_chars")
    later = lambda rows, s: rows.withColumn("updated", F.col("updated") + F.expr(f"interval {s} seconds"))
    done = later(docs, 5).withColumns({
        "status": F.when(F.col("lang") == "en", "completed").when(F.col("lang") == "fr", "processing").otherwise("failed"),
        "doc_type": F.when(F.col("n_chars") > 2000, "syllabus")})
    first = later(docs, 3).where("doc_id % 5 = 1").withColumns({"status": F.lit("completed"), "doc_type": F.lit("notes")})
    gone = later(docs, 9).where("doc_id % 11 = 4").withColumn("status", F.lit("deleted"))
    return LV.live_counts(spark, _live(spark, [docs.where("doc_id % 2 = 0").union(first), done, gone.union(docs)]))


@query("x5_drop_redelivered", "SELECT doc_id, count(*) AS n FROM documents GROUP BY doc_id")
def x5(spark, d):
    """Every document twice in a batch, and in two batches: the second brings all that the first
    brought, and documents whose own date is months older. Nothing is lost, nothing comes twice."""
    src, out, cp = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    docs = I.documents(spark, d).select("doc_id", "text", F.timestamp_seconds(1_704_067_200 - F.col("doc_id") * 86_400).alias("upload_date"))
    for part in (docs.where("doc_id % 2 = 0"), docs):
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(docs.schema).parquet(src)
        twice = stream.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
        _run(lambda: SP.write_latest(SI.drop_redelivered(twice), out, cp, mode="append", trigger={"availableNow": True}))
    return spark.read.parquet(out).groupBy("doc_id").agg(F.count("*").alias("n"))
