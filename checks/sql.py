"""SQL building blocks for the twins: expressions and named common table expressions."""
from __future__ import annotations

from docspark.functions import constants as K

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
SPACES = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(160)"
WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def str_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


STOP = in_list(K.STOPWORDS)


def strip(x):
    return f"trim({x}, {SPACES})"


def collapse(x):
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def ellipsis(x, n, keep=None, mark="…"):
    return f"(CASE WHEN length({x}) > {n} THEN substring({x}, 1, {keep or n}) || '{mark}' ELSE {x} END)"


def kept(parts, longer):
    return f"list_filter(list_transform({parts}, lambda s: {strip('s')}), lambda s: length(s) > {longer})"


def sentences(x, longer):
    return kept(f"string_split(regexp_replace({x}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))", longer)


def chunk_sentences(x):
    marked = f"regexp_replace({x}, '([.!?]){WS}+([A-Z\"''])', '\\1' || chr(1) || '\\2', 'g')"
    return kept(f"string_split(regexp_replace({marked}, '\\n{{2,}}', chr(1), 'g'), chr(1))", 0)


def words(x):
    return f"regexp_extract_all(lower({x}), '{WORD}')"


def tokens(x):
    return f"regexp_extract_all(strip_accents(lower({x})), '{TOKEN}')"


def fallback(x):
    s = sentences(collapse(x), 15)
    return (f"(CASE WHEN len({s}) > 0 THEN array_to_string(({s})[1:3], ' ') "
            f"ELSE {ellipsis(collapse(x), 300, mark='...')} END)")


def short(x):
    return ellipsis(f"array_to_string(({sentences(x, 20)})[1:2], ' ')", 280, 277)


def lines(x):
    return kept(f"string_split({x}, chr(10))", 0)


def overlaps(x, values):
    return f"list_has_any({x}, {str_list(values)})"


def doc_type_of(x):
    return (f"(CASE WHEN {overlaps(x, K.SYLLABUS_TAGS)} THEN 'syllabus' WHEN {overlaps(x, K.NOTES_TAGS)} THEN 'notes' "
            f"WHEN {overlaps(x, K.ASSIGN_TAGS)} THEN 'assign' ELSE 'other' END)")


def title_word(x):
    return f"(upper(substring({x}, 1, 1)) || lower(substring({x}, 2)))"


SRC = "CAST(substring(source, 4) AS INT)"
FILENAME = f"'doc_' || doc_id || (['.pdf', '.docx', '.txt', '.md', '.json', '.exe'])[{SRC} % 6 + 1]"
EXT = r"regexp_extract(lower({0}), '[^./\\](\.[^./\\]*)$', 1)"
SPECIAL = (f"(CASE WHEN {SRC} <= 2 THEN ['Syllabus'] WHEN {SRC} <= 4 THEN ['Lecture Notes'] WHEN {SRC} <= 7 THEN ['Homework'] "
           f"WHEN {SRC} = 8 THEN ['Fall 2024'] WHEN {SRC} = 9 THEN ['Graduate Level'] ELSE [] END)")


def cosine(a, b):
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


# name -> (names it needs, body)
CTE: dict[str, tuple[list[str], str]] = {
    "freq": ([], f"""
        SELECT doc_id, tf, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, phrase) - 1 AS pos FROM (
          SELECT doc_id, phrase, count(*) AS tf FROM (SELECT doc_id, unnest({words('text')}) AS phrase FROM documents)
          WHERE regexp_full_match(phrase, '[a-z]{{5,}}') AND phrase NOT IN {STOP} GROUP BY ALL)"""),
    "base": ([], f"""
        SELECT doc_id, {FILENAME} AS filename, strlen(text) AS file_size_bytes, CAST(ceil(length(text) / 2000) AS INT) AS page_count,
          {fallback('text')} AS summary, text, lang, source,
          CASE WHEN quality = 1 THEN ['Readable', upper(lang)] ELSE [] END AS subject,
          CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'processing' ELSE 'completed' END AS status,
          CASE WHEN toxic = 1 THEN 'bad text' END AS error_message,
          TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (doc_id) MINUTE AS upload_date,
          CASE WHEN {SRC} < 15 THEN {doc_type_of(SPECIAL)} END AS doc_type, {SPECIAL} AS special
        FROM documents LEFT JOIN labels USING (doc_id)"""),
    "catalog": (["base", "freq"], """
        SELECT base.*, list_concat(coalesce(w.t, []), special) AS tags FROM base LEFT JOIN (
          SELECT doc_id, list(phrase ORDER BY pos) AS t FROM freq WHERE pos < 5 AND tf >= 2 GROUP BY doc_id) w USING (doc_id)"""),
    "classes": (["catalog"], """
        SELECT doc_id, status, tags, 'language' AS dimension_id, lang AS value FROM catalog
        UNION ALL SELECT doc_id, status, tags, 'source', source FROM catalog
        UNION ALL SELECT doc_id, status, tags, 'subject', unnest(subject) FROM catalog"""),
    "dims": ([], "SELECT * FROM (VALUES ('language', 'Language', true, 1), ('source', 'Source', false, 2), "
                 "('doc_type', 'Document Type', true, 3)) t(dimension_id, display_name, is_multi_label, dim_order)"),
    "cats": ([], "SELECT DISTINCT 'language' AS dimension_id, lang AS name FROM documents "
                 "UNION ALL SELECT DISTINCT 'source', source FROM documents"),
    "pages": ([], f"""
        SELECT doc_id, CAST(k / 2000 + 1 AS BIGINT) AS page, {strip('substring(text, CAST(k AS BIGINT) + 1, 2000)')} AS text
        FROM (SELECT doc_id, text, unnest(range(0, length(text), 2000)) AS k FROM documents) WHERE text <> ''"""),
    "vecs": ([], """
        SELECT vec_id AS chunk_id, (vec_id // 3) * 7 AS doc_id, vec_id % 3 + 1 AS page, embedding, label,
          CASE WHEN label = 0 THEN 'v0' WHEN label > 1 THEN 'v1' END AS model_version FROM embeddings"""),
    "qs": ([], "SELECT item_id AS query_id, b.text, e.embedding FROM benchmark b LEFT JOIN embeddings e ON b.item_id = e.vec_id"),
    "qraw": (["qs"], f"SELECT query_id, list_filter({words('text')}, lambda t: length(t) > 1) AS raw FROM qs"),
    "qterms": (["qraw"], f"""
        SELECT query_id, CASE WHEN len(list_filter(raw, lambda t: t NOT IN {STOP})) > 0
          THEN list_filter(raw, lambda t: t NOT IN {STOP}) ELSE raw END AS terms FROM qraw WHERE len(raw) > 0"""),
    "qitems": (["qterms"], "SELECT query_id, item, count(*) AS weight FROM "
                           "(SELECT query_id, strip_accents(unnest(terms)) AS item FROM qterms) GROUP BY ALL"),
    "doctok": ([], f"SELECT doc_id, {tokens('text')} AS t FROM documents"),
    "postings": (["doctok"], "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM doctok) GROUP BY ALL"),
    "dl": (["doctok"], "SELECT doc_id, len(t) AS dl FROM doctok"),
    "bm": (["qitems", "postings", "dl"], f"""
        SELECT query_id, doc_id, sum(weight * idf * tf * {K.BM25_K1 + 1} / (tf + {K.BM25_K1} * (1 - {K.BM25_B} + {K.BM25_B} * dl / avgdl))) AS bm25
        FROM qitems JOIN postings ON item = term JOIN dl USING (doc_id)
        JOIN (SELECT term, greatest(ln(((SELECT count(*) FROM dl) - count(*) + 0.5) / (count(*) + 0.5)), {K.BM25_IDF_FLOOR}) AS idf
              FROM postings GROUP BY term) i ON i.term = item,
        (SELECT avg(dl) AS avgdl FROM dl) GROUP BY query_id, doc_id"""),
    "kw": (["bm"], f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS kw_rank FROM bm) "
                   f"WHERE kw_rank <= {K.KEYWORD_TOP}"),
    "sim": (["qs", "vecs"], f"""
        SELECT query_id, chunk_id, doc_id, round({cosine('qs.embedding', 'vecs.embedding')}, 12) AS s FROM qs, vecs WHERE qs.embedding IS NOT NULL"""),
    "sem": (["sim"], f"""
        SELECT query_id, chunk_id, doc_id, sem_rank, round(greatest(0.0, s), 4) AS similarity FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS sem_rank FROM sim) WHERE sem_rank <= {K.SEMANTIC_TOP}"""),
    "fused": (["kw", "sem"], f"""
        SELECT *, round({K.RRF_KW_WEIGHT} / ({K.RRF_K} + kw_rank) + {K.RRF_SEM_WEIGHT} / ({K.RRF_K} + sem_rank), 6) AS score FROM (
          SELECT s.query_id, s.doc_id, s.chunk_id, s.sem_rank, s.similarity, coalesce(k.kw_rank, coalesce(n.n, 0) + {K.RRF_K}) AS kw_rank
          FROM sem s LEFT JOIN kw k ON s.query_id = k.query_id AND s.doc_id = k.doc_id
          LEFT JOIN (SELECT query_id, count(*) AS n FROM kw GROUP BY 1) n ON n.query_id = s.query_id)"""),
    "pool": (["fused"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sem_rank) AS fused_rank "
                        "FROM fused) WHERE fused_rank <= 15"),
    "hits": (["pool", "base"], "SELECT p.*, b.filename, b.summary FROM pool p JOIN base b USING (doc_id)"),
    "cent": ([], """
        SELECT 't' || label AS label, list(x ORDER BY i) AS embedding FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (
          SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label"""),
    "lsim": (["cent"], f"SELECT vec_id AS doc_id, c.label, round({cosine('e.embedding', 'c.embedding')}, 12) AS s FROM embeddings e, cent c"),
    "topic": (["lsim"], "SELECT doc_id, 'topic' AS dimension_id, array_to_string(list(label ORDER BY label), '|') AS labels FROM lsim WHERE s > 0.4 GROUP BY doc_id "
                        "UNION ALL SELECT doc_id, 'best', label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, label) AS r FROM lsim WHERE s > 0.35) WHERE r = 1"),
    "prog": ([], "SELECT user_id AS doc_id, ts, event_type AS step, CAST(floor(value) AS INT) AS pct, props AS detail FROM events"),
    "lastp": (["prog"], "SELECT doc_id, ts, step, pct, detail FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, step DESC, pct DESC, detail DESC) AS r FROM prog) WHERE r = 1"),
    "evpages": ([], "SELECT event_id // 400 AS doc_id, (event_id // 40) % 10 AS page, "
                    "string_agg('U' || user_id || ' ' || event_type || ' ' || props, chr(10) ORDER BY event_id) AS text FROM events GROUP BY 1, 2"),
    "conv": ([], "SELECT conv_id AS doc_id, turn + 1 AS page, text, role FROM conversations"),
    "cells": ([], """
        SELECT event_id // 400 AS doc_id, (event_id // 40) % 10 AS page, (event_id // 20) % 2 AS table_no, event_id % 20 AS row_no, col_no, text FROM (
          SELECT event_id, 0 AS col_no, event_type AS text FROM events
          UNION ALL SELECT event_id, 1, CASE WHEN event_type <> 'error' THEN CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END FROM events
          UNION ALL SELECT event_id, 2, replace(props, ': ', ':' || chr(10)) FROM events WHERE value > 5
          UNION ALL SELECT event_id, 3, event_type FROM events WHERE value > 5)"""),
    "blocks": ([], """
        SELECT doc_id, n // 20 + 1 AS page, n AS block_no, (n % 2) * 300.0::DOUBLE AS x0, ((n % 20) // 2) * 14.0::DOUBLE AS y0,
          10 + length(text) % 5 AS h, text, CASE WHEN length(text) > 1500 THEN 1 ELSE 0 END AS block_type
        FROM (SELECT doc_id, unnest(l) AS text, unnest(range(0, len(l))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""),
}


#: Letters beyond ASCII in the test texts, each for one character that lower-case words don't hold: DuckDB's distance counts bytes.
ACCENTS = ("éóèñüçêäößí", "ABCDEFGHIJK")


def keyphrase_ctes(source: str, top: int, name: str = "kp", dedup: float = 0.7) -> str:
    """Keyphrases of (doc_id, text) rows as `name` (doc_id, pos, phrase, score): features by word, candidates by score,
    taken one by one unless too close to one taken before."""
    n, plain = name, f"translate({{}}, {quote(ACCENTS[0])}, {quote(ACCENTS[1])})"
    marked = f"replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(10), chr(1))"
    return f"""
    {n}s AS (SELECT doc_id, len(l) AS n_sents, unnest(l) AS s, unnest(range(0, len(l))) AS sent FROM (
      SELECT doc_id, list_filter(string_split({marked}, chr(1)), lambda x: regexp_matches(x, '\\p{{L}}')) AS l FROM ({source}))),
    {n}r AS (SELECT doc_id, n_sents, sent, unnest(l) AS s, unnest(range(0, len(l))) AS run FROM (
      SELECT *, regexp_split_to_array(s, '[^\\p{{L}}\\p{{N}}_\\s\\x0b\\p{{Z}}]+') AS l FROM {n}s)),
    {n}w AS (SELECT doc_id, n_sents, sent, run, unnest(l) AS tok, unnest(range(0, len(l))) AS spot, unnest([NULL] || l[1:len(l) - 1]) AS before, unnest(l[2:] || [NULL]) AS after FROM (
      SELECT *, list_filter(regexp_split_to_array(s, '{WS}+'), lambda x: x <> '') AS l FROM {n}r) WHERE len(l) > 0),
    {n}t AS (SELECT doc_id, n_sents, sent, run, spot, lower(tok) AS term, lower(before) AS before, lower(after) AS after, regexp_matches(tok, '^\\p{{Lu}}{{2,}}$') AS up,
        regexp_matches(tok, '^\\p{{Lu}}') AND run + spot > 0 AND NOT regexp_matches(tok, '^\\p{{Lu}}{{2,}}$') AS proper FROM {n}w
      WHERE length(tok) >= 3 AND lower(tok) NOT IN {STOP} AND NOT regexp_matches(tok, '\\p{{N}}|_')),
    {n}f AS (SELECT *, max(tf) OVER (PARTITION BY doc_id) AS most, avg(tf) OVER (PARTITION BY doc_id) + stddev_pop(tf) OVER (PARTITION BY doc_id) AS usual FROM (
      SELECT doc_id, term, n_sents, count(*) AS tf, greatest(count(*) FILTER (up), count(*) FILTER (proper)) AS cased, median(sent) AS mid, count(DISTINCT sent) AS spread,
        coalesce(count(DISTINCT before) / nullif(count(before), 0), 0) + coalesce(count(DISTINCT after) / nullif(count(after), 0), 0) AS vary FROM {n}t GROUP BY ALL)),
    {n}h AS (SELECT doc_id, term, (rel * ln(ln(mid + 3))) / (cased / (1 + ln(tf)) + (tf / usual) / rel + (spread / n_sents) / rel) AS h FROM (SELECT *, 1 + vary * tf / most AS rel FROM {n}f)),
    {n}l AS (SELECT doc_id, term, h, lead(term) OVER o AS term2, lead(h) OVER o AS h2, lead(sent) OVER o = sent AND lead(run) OVER o = run AND lead(spot) OVER o = spot + 1 AS near
      FROM {n}t JOIN {n}h USING (doc_id, term) WINDOW o AS (PARTITION BY doc_id ORDER BY sent, run, spot)),
    {n}c AS (SELECT doc_id, phrase, round(max(prod) / (count(*) * (1 + max(total))), 12) AS score FROM (
      SELECT doc_id, term AS phrase, h AS prod, h AS total FROM {n}l UNION ALL SELECT doc_id, term || ' ' || term2, h * h2, h + h2 FROM {n}l WHERE near) GROUP BY ALL),
    {n}o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, phrase) AS r FROM {n}c),
    {n}g AS (
      SELECT doc_id, 0::BIGINT AS r, []::VARCHAR[] AS kept, NULL::VARCHAR AS phrase, NULL::DOUBLE AS score, 0::BIGINT AS k FROM {n}o WHERE r = 1
      UNION ALL
      SELECT doc_id, r, CASE WHEN ok THEN list_append(kept, phrase) ELSE kept END, CASE WHEN ok THEN phrase END, CASE WHEN ok THEN score END, CASE WHEN ok THEN k + 1 ELSE k END FROM (
        SELECT g.doc_id, o.r, kept, o.phrase, o.score, k, len(list_filter(kept, lambda a: 1 - levenshtein({plain.format('a')}, {plain.format('o.phrase')}) / greatest(length(a), length(o.phrase)) > {dedup})) = 0 AS ok
        FROM {n}g g JOIN {n}o o ON o.doc_id = g.doc_id AND o.r = g.r + 1 WHERE k < {top})),
    {n} AS (SELECT doc_id, k - 1 AS pos, phrase, score FROM {n}g WHERE phrase IS NOT NULL)"""


def hashed(key: str, source: str) -> str:
    """(key, v): the default encoder's sums of (key, text) rows, before they are scaled to unit length."""
    return f"""(SELECT {key}, list_transform(range(0, 64), lambda b: CAST(len(list_filter(c, lambda x: x = b)) - len(list_filter(c, lambda x: x = b + 64)) AS DOUBLE)) AS v FROM (
      SELECT {key}, list_transform({words('text')}, lambda t: CAST('0x' || substring(md5(t), 1, 2) AS INT) % 128) AS c FROM ({source})))"""


def hash_cosine(a: str, b: str) -> str:
    dot = "list_dot_product({0}, {1})"
    return f"round(coalesce({dot.format(a, b)} / nullif(sqrt({dot.format(a, a)} * {dot.format(b, b)}), 0), 0), 12)"


def title(x):
    """Title case of every run of letters."""
    return f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|\\P{{L}}+'), lambda r: CASE WHEN substring(r, 1, 1) = 'ß' THEN 'Ss' ELSE upper(substring(r, 1, 1)) END || lower(substring(r, 2))), '')"


def content_ctes(source: str, n: int, name: str = "ck") -> str:
    """The first n acceptable phrases of keyphrases, frequent words and pairs, and repeated words as `name` (doc_id, pos, tag)."""
    return keyphrase_ctes(source, 3 * n, f"{name}kp") + f""",
    {name}w AS (SELECT doc_id, list_filter({words('text')}, lambda t: length(t) > 1 AND t NOT IN {STOP}) AS w, {words('text')} AS every FROM (
      SELECT doc_id, regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g') AS text FROM ({source}))),
    {name}p AS (SELECT doc_id, unnest(w) AS phrase FROM {name}w UNION ALL
      SELECT doc_id, a || ' ' || b FROM (SELECT doc_id, unnest(w) AS a, unnest(w[2:]) AS b FROM {name}w) WHERE b IS NOT NULL),
    {name}a AS (SELECT doc_id, 1 AS stage, pos, phrase FROM {name}kp
      UNION ALL SELECT doc_id, 3, r - 1, phrase FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, phrase) AS r FROM (SELECT doc_id, phrase, count(*) AS tf FROM {name}p GROUP BY ALL)) WHERE r <= 50
      UNION ALL SELECT doc_id, 4, r - 1, phrase FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, phrase) AS r FROM (
        SELECT doc_id, phrase, count(*) AS tf FROM (SELECT doc_id, unnest(every) AS phrase FROM {name}w) WHERE regexp_full_match(phrase, '[a-z]{{5,}}') AND phrase NOT IN {STOP} GROUP BY ALL)) WHERE r <= 30 AND tf >= 2),
    {name}b AS (SELECT doc_id, lower(trim(phrase)) AS key, min((stage, pos, phrase)) AS b FROM {name}a WHERE length(trim(phrase)) >= 4 AND NOT regexp_matches(trim(phrase), '^[0-9]') GROUP BY ALL),
    {name} AS (SELECT doc_id, place - 1 AS pos, {title('b[3]')} AS tag FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b[1], b[2]) AS place FROM {name}b) WHERE place <= {n})"""


LABELS = f"SELECT name AS label FROM cats UNION SELECT unnest({str_list(K.FIXED_LABELS)})"


def tags_ctes(source: str, n: int = 10, keep: int = 8, name: str = "dt", labels: str = LABELS) -> str:
    """Tags at ingest as `name` (doc_id, tags): content keywords that are no taxonomy label, joined."""
    return content_ctes(source, n, f"{name}ck") + f""",
    {name} AS (SELECT doc_id, string_agg(tag, '|' ORDER BY place) AS tags FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM {name}ck WHERE lower(tag) NOT IN (SELECT lower(label) FROM ({labels}))) WHERE place <= {keep} GROUP BY 1)"""


def chunk_ctes(pages: str) -> str:
    """Sentence chunks of (doc_id, page, text) rows by stepping through the sentences."""
    return f"""
    pg AS ({pages}),
    st AS (SELECT doc_id, page, i, s, length(s) AS n, length(s) > 1350 AS giant,
             count(*) FILTER (length(s) <= 1350) OVER (PARTITION BY doc_id, page ORDER BY i) - 1 AS g FROM (
           SELECT doc_id, page, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, page, {chunk_sentences('text')} AS l FROM pg))),
    fold AS (
      SELECT doc_id, page, 0::BIGINT AS i, 0::BIGINT AS f, 0::BIGINT AS nx, 0::BIGINT AS held, 0::BIGINT AS t1, 0::BIGINT AS t2,
             false AS closed, 0::BIGINT AS cf, 0::BIGINT AS cl FROM pg
      UNION ALL
      SELECT doc_id, page, i, CASE WHEN c THEN nx - k ELSE f END, CASE WHEN giant THEN nx ELSE nx + 1 END,
             (CASE WHEN c THEN (CASE WHEN k = 2 THEN t1 + t2 ELSE t1 END) ELSE held END) + (CASE WHEN giant THEN 0 ELSE n END),
             CASE WHEN giant THEN t1 ELSE n END, CASE WHEN giant THEN t2 ELSE t1 END, c, f, nx - 1
      FROM (SELECT fold.doc_id, fold.page, st.i, f, nx, held, t1, t2, st.n, st.giant,
                   nx > f AND (st.giant OR held + st.n > 900) AS c, least(2, nx - f) AS k
            FROM fold JOIN st ON st.doc_id = fold.doc_id AND st.page = fold.page AND st.i = fold.i + 1)),
    ranges AS (
      SELECT doc_id, page, i AS spot, cf AS a, cl AS b FROM fold WHERE closed
      UNION ALL
      SELECT doc_id, page, 1000000000, f, nx - 1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY i DESC) AS r FROM fold) WHERE r = 1 AND nx > f),
    parts AS (
      SELECT r.doc_id, r.page, r.spot, 0 AS sub, string_agg(st.s, ' ' ORDER BY st.i) AS text FROM ranges r
      JOIN st ON st.doc_id = r.doc_id AND st.page = r.page AND NOT st.giant AND st.g BETWEEN r.a AND r.b GROUP BY r.doc_id, r.page, r.spot
      UNION ALL
      SELECT doc_id, page, i, CAST(k // 800 + 1 AS INT), {strip('substring(s, CAST(k AS BIGINT) + 1, 900)')} FROM (
        SELECT *, unnest(range(0, n, 800)) AS k FROM st WHERE giant)),
    chunks AS (
      SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY spot, sub) - 1 AS part, text FROM parts
      WHERE length({strip('text')}) >= 20)"""


def build(select: str, *names: str, recursive: str = "") -> str:
    """A full statement: the named expressions with all they need, then the select."""
    done: list[str] = []

    def need(n):
        for m in CTE[n][0]:
            need(m)
        if n not in done:
            done.append(n)

    for n in names:
        need(n)
    parts = [f"{n} AS ({CTE[n][1].strip()})" for n in done]
    if recursive:
        parts.append(recursive.strip())
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + " " if parts else "") + select
