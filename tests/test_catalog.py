import datetime as dt

import pytest
from pyspark.sql import functions as F

from docspark.operators import catalog as C, classify as CL, maintain as U
from docspark.plans.ingest import IngestOptions, ingest, searchable
from docspark.sources import files as SF, tables as ST
from docspark.streaming import ingest as SI, progress as SP
from docspark.session import shared_dir

CAT = ("doc_id string, filename string, summary string, tags array<string>, classifications map<string,array<string>>, "
       "doc_type string, status string, error_message string, upload_date timestamp")
T0 = dt.datetime(2024, 1, 1, 12)


def row(i, tags=("x",), cls=None, status="completed", summary="sum", doc_type=None, hours=0):
    return (i, f"{i}.txt", summary, list(tags) if tags is not None else None, cls, doc_type, status, None, T0 - dt.timedelta(hours=hours))


@pytest.fixture(scope="module")
def dims(spark):
    return spark.createDataFrame([("topic", "Topic", True, 2), ("kind", "Kind", False, 1), ("empty", "Empty", True, 3)],
                                 "dimension_id string, display_name string, is_multi_label boolean, dim_order int")


def test_listing_filters(spark):
    docs = spark.createDataFrame([
        row("a", ["Homework"], {"lang": ["en"]}, hours=2), row("b", ["Syllabus", "x"], {"lang": ["de", "en"]}, hours=1),
        row("c", None, None, "failed"), row("d", ["x"], {"other": ["en"]}, doc_type="notes", hours=3)], CAT)
    ids = lambda **k: [r.doc_id for r in C.list_documents(docs, **k).collect()]
    assert ids() == ["c", "b", "a", "d"] and ids(doc_type="", tag=None, dimension="lang") == ["c", "b", "a", "d"]
    assert ids(tag="x") == ["b", "d"] and ids(doc_type="assign") == ["a"] and ids(doc_type="notes") == ["d"] and ids(doc_type="other") == ["c"]
    assert ids(dimension="lang", value="en") == ["b", "a"]


def test_retag_selection(spark):
    docs = spark.createDataFrame([
        row("a", ["Uncategorized"]), row("b", ["General"]), row("c", []), row("d", None), row("e", summary=None), row("f", summary=""),
        row("g", summary="AI summary missing", status="failed"), row("h"), row("i", ["General", "x"]), row("j", status="failed")], CAT)
    assert sorted(r.doc_id for r in C.needs_retag(docs).collect()) == list("abcdefg")
    assert sorted(r.doc_id for r in C.needs_retag(docs, True).collect()) == list("abcdefhi")
    text = spark.createDataFrame([(k, "This is the only sentence here. Zebra zebra.") for k in "ah"], "doc_id string, text string")
    new, changes = U.retag(docs, text)
    assert changes.count() == 7 and new.count() == 10
    got = {r.doc_id: (r.tags, r.summary) for r in new.collect()}
    assert got["h"] == (["x"], "sum") and got["b"] == ([], "") and "Zebra" in got["a"][0]


def test_stale_versions_and_processing(spark):
    v = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "")], "chunk_id long, model_version string")
    assert [r.chunk_id for r in C.stale_versions(v, "a").collect()] == [2]
    docs = spark.createDataFrame([row("old", status="processing", hours=3), row("new", status="processing", hours=1), row("done", hours=9)], CAT)
    got = {r.doc_id: r.status for r in C.stale_processing(docs, T0).collect()}
    assert got == {"old": "failed", "new": "processing", "done": "completed"}
    assert {r.doc_id for r in C.retryable(docs).collect()} == {"old", "new"}


def test_rollups(spark, dims):
    docs = spark.createDataFrame([
        row("a", ["t", "t", "u"], {"topic": ["p", ""], "new_dim": ["v"]}), row("b", ["t"], {"topic": ["p", "q"], "kind": None}),
        row("c", [], {"topic": ["r"]}), row("d", ["z"], {"topic": ["p"]}, "failed")], CAT)
    assert [tuple(r) for r in C.tag_counts(docs).collect()] == [("t", 3), ("u", 1)]
    p = [(r.dimension_id, r.label, r.value, r.n) for r in C.perspectives(docs, dims).collect()]
    assert p == [("topic", "Topic", "p", 2), ("topic", "Topic", "q", 1), ("topic", "Topic", "r", 1), ("new_dim", "New Dim", "v", 1)]
    h = [(r.dimension_id, r.value, r.value_total, r.tag, r.n) for r in C.tag_hierarchy(docs, dims).collect()]
    assert h[:2] == [("topic", "p", 4, "t", 3), ("topic", "p", 4, "u", 1)] and not any(x[1] == "r" for x in h)
    assert C.document_counts(docs).collect()[0].asDict() == {"all": 3, "syllabus": 0, "notes": 0, "assign": 0, "other": 3, "processing": 0, "failed": 1}


def test_taxonomy(spark, dims):
    cats = spark.createDataFrame([("topic", "p"), ("topic", "q")], "dimension_id string, name string")
    labels = {r.dimension_id: r.labels for r in CL.taxonomy_labels(dims, cats).collect()}
    assert labels == {"kind": [], "topic": ["p", "q"], "empty": []}
    new = spark.createDataFrame([(1, "topic", "p"), (2, "field_of_work", "x"), (3, "field_of_work", "x"), (4, "topic", "z")], "doc_id long, dimension_id string, category_name string")
    d, c = CL.merge_taxonomy(dims, cats, new)
    assert d.count() == 4 and d.filter("dimension_id = 'field_of_work'").first().display_name == "Field Of Work" and c.count() == 4


def test_upsert_delete_reset(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id long, v string")
    n = spark.createDataFrame([(1, "n"), (3, "m")], "doc_id long, v string")
    assert sorted(map(tuple, U.upsert(t, n).collect())) == [(1, "n"), (2, "c"), (3, "m")]
    assert [tuple(r) for r in U.delete_documents({"chunks": t}, n)["chunks"].collect()] == [(2, "c")]
    out = U.reset_corpus({"chunks": t, "categories": n})
    assert out["chunks"].count() == 0 and out["categories"].count() == 2


def test_intake(spark):
    mb = 120 * 1024 * 1024
    rows = [("/a", "A.PDF", mb), ("/b", "b.docx", mb + 1), ("/c", "c.csv", 1), ("/d", "d.exe", 1), ("/e", "noext", 1), ("/z", "A.PDF", 5), ("/f", "f.json", 1)]
    files = spark.createDataFrame(rows, "path string, name string, length long")
    got = {r.path: (r.reason, r.duplicate_name) for r in SF.accept_files(files).collect()}
    no = "unsupported format"
    assert got == {"/a": (None, False), "/z": (None, True), "/b": ("too large", False), "/c": (no, False), "/d": (no, False), "/e": (no, False), "/f": (None, False)}
    ids = [r.doc_id for r in SF.register_documents(files).collect()]
    assert len(set(ids)) == 7 and ids == [r.doc_id for r in SF.register_documents(files).collect()]


def test_text_files_and_stream_equal_batch(spark, dims, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_bytes(b"  The first caf\xc3\xa9 file has\xff enough words to be kept. Another sentence follows here.  ")
    (tmp_path / "in" / "blank.md").write_bytes(b"   \n ")
    (tmp_path / "in" / "skip.exe").write_bytes(b"nothing")
    got = {r.path.split("/")[-1]: r.text for r in SF.read_text_corpus(spark, str(tmp_path / "in")).collect()}
    assert got == {"one.txt": "The first café file has enough words to be kept. Another sentence follows here.", "blank.md": ""}
    cats = spark.createDataFrame([("topic", "words"), ("kind", "file")], "dimension_id string, name string")
    out = shared_dir(spark)
    SI.ingest_stream(SI.text_file_stream(spark, str(tmp_path / "in")), out, shared_dir(spark), dims, cats).awaitTermination()
    t = SI.read_tables(spark, out)
    cat = {r.filename: r for r in t["catalog"].collect()}
    assert cat["skip.exe"].status == "failed" and cat["skip.exe"].error_message == "unsupported format"
    assert cat["blank.md"].status == "failed" and "No extractable text" in cat["blank.md"].error_message
    assert cat["one.txt"].status == "completed" and cat["one.txt"].page_count == 1 and cat["one.txt"].tags
    assert t["chunks"].first().chunk_id == cat["one.txt"].doc_id + "_chunk_0"
    files = t["catalog"].select("doc_id", "filename", "file_size_bytes", "upload_date").join(
        SF.read_text_corpus(spark, str(tmp_path / "in")).withColumn("filename", F.element_at(F.split("path", "/"), -1)), "filename")
    batch = ingest(files, dims, cats)
    t["catalog"] = t["catalog"].where("filename <> 'skip.exe'")
    for name in ("catalog", "chunks", "postings", "doc_text"):
        cols = [c for c in batch[name].columns if c not in ("classifications", "entities")]
        assert sorted(map(str, batch[name].select(cols).collect())) == sorted(map(str, t[name].select(cols).collect())), name
    assert searchable(batch).columns[0] == "chunk_id"


def test_redelivered_document_replaces_its_rows(spark, dims):
    cats = spark.createDataFrame([("topic", "words")], "dimension_id string, name string")
    schema = "doc_id string, filename string, file_size_bytes long, upload_date timestamp, text string"
    long = " ".join(f"Sentence number {i} has several words in it." for i in range(60))
    out = shared_dir(spark)
    opts = IngestOptions()
    SI.ingest_batch(spark.createDataFrame([("d", "d.txt", 1, T0, long), ("e", "e.txt", 1, T0, long)], schema), 0, out, dims, cats, opts)
    n = SI.read_tables(spark, out)["chunks"].filter("doc_id = 'd'").count()
    SI.ingest_batch(spark.createDataFrame([("d", "d.txt", 2, T0 + dt.timedelta(1), "Now it is one short text only."), ("d", "d.txt", 2, T0, "older")], schema), 1, out, dims, cats, opts)
    for _ in range(2):  # a repeated batch changes nothing
        t = SI.read_tables(spark, out)
        assert n > 2 and [r.text for r in t["chunks"].filter("doc_id = 'd'").collect()] == ["Now it is one short text only."]
        assert t["catalog"].count() == 2 and t["chunks"].filter("doc_id = 'e'").count() == n
        SI.ingest_batch(spark.createDataFrame([("d", "d.txt", 2, T0 + dt.timedelta(1), "Now it is one short text only.")], schema), 1, out, dims, cats, opts)


def test_a_half_written_batch_is_not_seen(spark, dims):
    cats = spark.createDataFrame([("topic", "words")], "dimension_id string, name string")
    schema = "doc_id string, filename string, file_size_bytes long, upload_date timestamp, text string, reason string"
    out = shared_dir(spark)
    rows = [("d", "d.txt", 1, T0, "A text that is long enough to be kept as a chunk.", None), ("r", "r.exe", 1, T0, "x", "unsupported format")]
    SI.ingest_batch(spark.createDataFrame(rows, schema), 0, out, dims, cats, IngestOptions())
    before = {n: sorted(map(str, df.collect())) for n, df in SI.read_tables(spark, out).items()}
    assert {r.doc_id: r.error_message for r in SI.read_tables(spark, out)["catalog"].collect()} == {"d": None, "r": "unsupported format"}
    spark.read.parquet(f"{out}/chunks/part=b0/batch=0").write.parquet(f"{out}/chunks/part=b1/batch=1")  # a batch that ended before its commit
    assert {n: sorted(map(str, df.collect())) for n, df in SI.read_tables(spark, out).items()} == before


def test_repeated_changes_of_a_row_count_once(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, v string")
    changes = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "doc_id int, v string")
    assert sorted(map(tuple, U.update_columns(target, changes, ["v"]).collect())) == [(1, "y"), (2, "b")]


def test_newest_batch_is_read(spark):
    out = shared_dir(spark)
    spark.range(3).write.parquet(f"{out}/batch=1")
    spark.range(5).write.parquet(f"{out}/batch=12")
    assert SP.read_latest(spark, out).count() == 5 and SP.read_latest(spark, out).columns == ["id"]


def progress_rows(spark, path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(1, at(0), "parsing", 5, ""), (1, at(2), "chunking", 70, ""), (1, at(1), "ai_tagging", 65, ""),   # out of order, then silent
            (2, at(200), "saving", 97, ""), (2, at(300), "saving", 98, ""), (3, at(1), "parsing", 5, ""), (3, at(5), "completed", 100, "")]
    spark.createDataFrame(rows, "doc_id long, ts timestamp, step string, pct int, detail string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_progress_batch_and_stream(spark):
    path, out, cp = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    p = progress_rows(spark, path)
    last = {r.doc_id: r.step for r in SP.latest_progress(p).collect()}
    assert last == {1: "chunking", 2: "saving", 3: "completed"}
    assert {r.doc_id for r in SP.latest_progress(p, keep_done=False).collect()} == {1, 2}
    now = F.lit(T0 + dt.timedelta(minutes=122))
    assert SP.silent_documents(p, now).count() == 0
    assert [r.doc_id for r in SP.silent_documents(p, F.lit(T0 + dt.timedelta(minutes=123))).collect()] == [1]
    s = spark.readStream.schema(p.schema).parquet(path)
    SP.write_latest(SP.track_progress(s), out, cp, mode="update", trigger={"availableNow": True}).awaitTermination()
    seen = {(r.doc_id, r.status) for r in spark.read.parquet(out).collect()}
    assert {(1, "processing"), (2, "processing"), (3, "completed")} <= seen and (3, "failed") not in seen and (2, "failed") not in seen
    # Watermark reaches 12:00 + 300 min - 120 min = 180 min; document 1 fell silent at 122.
    assert (1, "failed") in seen


def test_ingest_status_defaults(spark):
    docs = spark.createDataFrame([row("a", status="processing"), row("b"), row("c", status="failed"), row("d", status="processing")], CAT)
    prog = spark.createDataFrame([("d", T0, "chunking", 70, "x")], "doc_id string, ts timestamp, step string, pct int, detail string")
    ids = spark.createDataFrame([(x,) for x in "abcdz"], "doc_id string")
    got = {r.doc_id: (r.status, r.step, r.pct) for r in C.ingest_status(docs, prog, ids).collect()}
    assert got == {"a": ("processing", "queued", 0), "b": ("completed", "completed", 100), "c": ("failed", "failed", 0),
                   "d": ("processing", "chunking", 70), "z": ("missing", None, None)}


def test_catalog_json_roundtrip(spark):
    raw = spark.createDataFrame([("a", '["x","y"]', '{"k":["v"]}', None, ""), ("b", None, "", "[]", None)],
                                "doc_id string, tags string, classifications string, key_findings string, entities string")
    path = shared_dir(spark)
    ST.write_catalog(raw, path)
    got = {r.doc_id: r for r in ST.read_catalog(spark, path).collect()}
    assert got["a"].tags == ["x", "y"] and got["a"].classifications == {"k": ["v"]} and got["a"].entities.Dates == []
    assert got["b"].tags == [] and got["b"].classifications == {} and got["b"].key_findings == []


def test_present_documents(spark):
    schema = CAT + ", file_size_bytes long, page_count int"
    docs = spark.createDataFrame([
        (*row("a", ["t1", "t2", "t3", "t4"], {"subject": ["s1", "s2", "s3"], "methodology": ["m1", "m2"]}, summary="x  y\n" + "z" * 90), 1536, 1),
        (*row("b", ["t1", "t2", "t3"], {}, summary="A SciFact text"), 0, 3)], schema)
    a, b = C.present_documents(docs).orderBy("doc_id").collect()
    assert (a.meta, a.pills, a.shown_tags) == ("1 pg · 1.5 KB", ["s1", "s2", "m1"], ["t1", "t2", "t3"])
    assert a.short_summary == ("x y " + "z" * 90)[:78] + "…" and b.summary_line == "" and b.meta == "3 pgs" and b.pills == ["t1", "t2"]


def test_late_record_does_not_restart_an_ended_document(spark):
    path, out, cp = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    schema = "doc_id long, ts timestamp, step string, pct int, detail string"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    for rows in ([(1, at(5), "completed", 100, ""), (2, at(5), "saving", 97, "")], [(1, at(3), "saving", 97, "")], [(3, at(400), "saving", 97, "")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    SP.write_latest(SP.track_progress(s), out, cp, mode="update", trigger={"availableNow": True}).awaitTermination()
    seen = {(r.doc_id, r.step, r.status) for r in spark.read.parquet(out).collect()}
    assert {x for x in seen if x[0] == 1} == {(1, "completed", "completed")}
    assert (2, "saving", "failed") in seen and (3, "saving", "failed") not in seen


def test_a_large_bucket_is_split(spark, tmp_path):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        docs = spark.range(40_000, numPartitions=4).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("term"))
        ST.write_index(docs.select("doc_id"), docs.select("doc_id"), docs, str(tmp_path / "i"), buckets=2)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    got = ST.read_index(spark, str(tmp_path / "i"))["postings"]
    files = got.groupBy("bucket", F.input_file_name().alias("file")).count().groupBy("bucket").count().collect()
    assert len(files) == 2 and all(r["count"] > 1 for r in files)
    assert got.count() == 40_000 and got.select("doc_id").distinct().count() == 40_000
