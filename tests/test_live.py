"""Live counts with retractions, and versions of tables behind a manifest."""
import datetime as dt

import pytest

from docspark.operators import vectors as V
from docspark.sources.snapshots import Snapshots
from docspark.streaming import live as L

T0 = dt.datetime(2024, 1, 1)
KIND = "doc_id string, updated timestamp, status string, doc_type string, tags array<string>"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def feed(spark, tmp_path, rounds):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for rows in rounds:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(src)
        run = L.write_live(spark.readStream.schema(KIND).parquet(src), out, cp, trigger={"availableNow": True})
        run.awaitTermination()
        yield L.live_counts(spark, out).first().asDict(), {r.tag: r.n for r in L.live_tags(spark, out).collect()}


def test_a_document_is_counted_once(spark, tmp_path):
    zero = dict.fromkeys(L.COUNTS, 0)
    rounds = [
        [("a", at(0), "processing", None, None), ("b", at(0), "processing", "notes", ["x"]), (None, at(0), "completed", None, ["lost"]), ("n", None, "completed", None, ["lost"])],
        [("a", at(1), "completed", "notes", ["x", "y"]), ("a", at(2), "completed", "notes", ["y", "z"])],
        [("a", at(1), "failed", None, []), ("b", at(3), "failed", None, ["x"]), ("c", at(3), "completed", "", ["y", "y"])],
        [("a", at(2), "completed", "notes", ["y", "z"]), ("c", at(9), "deleted", None, None), ("d", at(1), "odd", None, ["q"])],
    ]
    got = list(feed(spark, tmp_path, rounds))
    assert got[0] == (zero | {"processing": 2}, {})
    assert got[1] == (zero | {"all": 1, "notes": 1, "processing": 1}, {"y": 1, "z": 1})
    assert got[2] == (zero | {"all": 2, "notes": 1, "other": 1, "failed": 1}, {"y": 3, "z": 1})
    assert got[3] == (zero | {"all": 1, "notes": 1, "failed": 1}, {"y": 1, "z": 1})


def test_a_repeated_batch_and_old_folders(spark, tmp_path):
    out = str(tmp_path / "live")
    rows = lambda n: spark.createDataFrame([(f"d{n}", 1, "completed", "notes", ["t"])], "doc_id string, sign int, status string, doc_type string, tags array<string>")
    for n in range(8):
        L.save_changes(rows(n), n, out, folders=3, keep=2)
        L.save_changes(rows(n), n, out, folders=3, keep=2)
    assert L.live_counts(spark, out).first()["notes"] == 8 and L.live_tags(spark, out).first()["n"] == 8
    shots = Snapshots(spark, out)
    assert len(shots.versions()) == 2 and len(shots.read()["tables"]["tags"]) <= 3
    assert {p.name for p in (tmp_path / "live" / "tags").iterdir() if p.is_dir()} <= {f"b{n}" for n in range(4, 8)} | {"b3"}


def test_readers_see_one_version(spark, tmp_path):
    shots = Snapshots(spark, str(tmp_path / "s"))
    assert shots.read() == {"tables": {}} and shots.versions() == []
    assert shots.table("t", schema="a int").count() == 0
    with pytest.raises(ValueError):
        shots.table("t")
    spark.range(3).write.parquet(f"{shots.root}/t/one")
    assert shots.table("t", schema="id long").count() == 0  # not committed
    shots.commit({"tables": {"t": ["t/one"]}})
    old = shots.read()
    spark.range(5).write.parquet(f"{shots.root}/t/two")
    assert shots.table("t").count() == 3
    shots.commit({"tables": {"t": ["t/two"]}})
    assert shots.table("t").count() == 5 and shots.table("t", old).count() == 3
    assert shots.vacuum(1) == ["t/one"] and shots.versions() == [1] and shots.table("t").count() == 5


VEC = "chunk_id long, embedding array<float>"


@pytest.mark.parametrize("ship", [4096, 2])
def test_bad_vectors_are_left_out(spark, ship):
    nan, inf = float("nan"), float("inf")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [None, 1.0]), (8, []), (9, [0.0, 0.0])], VEC)
    queries = spark.createDataFrame([(10, [1.0, 0.1]), (11, [0.0, 2.0]), (12, None), (13, [nan, 0.0]), (14, [1.0, 1.0, 1.0]), (15, [3.0, 0.0]), (15, [3.0, 0.0])],
                                    "query_id long, embedding array<float>")
    got = V.vector_topk(queries, vectors, 2, ship_rows=ship).collect()
    assert sorted((r.query_id, r.chunk_id, r.sem_rank) for r in got if r.query_id != 15) == [(10, 1, 1), (10, 2, 2), (11, 1, 2), (11, 2, 1)]
    assert {r.chunk_id for r in got if r.query_id == 15} <= {1, 2, 9}
    assert {r.reason: r.n for r in V.rejected_vectors(vectors, 2).collect()} == {"no vector": 1, "other length": 2, "null or not finite": 3}
    assert V.vector_topk(queries.where("query_id = 12"), vectors, 2).count() == 0
    assert "Exchange" not in V._pairs(vectors, queries, "chunk_id", "query_id", "embedding", 2, None, 4096)._jdf.queryExecution().executedPlan().toString()


def test_verbatim_documents(spark):
    from docspark.operators.quality import verbatim_documents

    docs = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "quick brown foxes jump"), (3, None), (4, ""), (5, "a b"), (6, "xa by the quick brown fox")], "doc_id long, text string")
    asked = spark.createDataFrame([(10, "quick brown fox"), (11, "he quick brown f"), (12, "a b"), (13, ""), (14, None), (15, "quick red fox"), (16, "fox"), (17, "a  b"), (10, "quick brown fox")],
                                  "query_id long, text string")
    got = sorted((r.query_id, r.doc_id) for r in verbatim_documents(asked, docs).collect())
    assert got == [(10, 1), (10, 2), (10, 6), (11, 1), (11, 6), (12, 5), (12, 6), (16, 1), (16, 2), (16, 6)]


def test_places_and_failing_encoder(spark):
    from docspark.functions import hooks
    from docspark.operators.catalog import newest_places
    from docspark.plans.ingest import IngestOptions, ingest

    docs = spark.createDataFrame([(i, T0 + dt.timedelta(minutes=i % 7)) for i in range(50)], "doc_id long, upload_date timestamp").repartition(5)
    want = [i for i in sorted(range(50), key=lambda i: (-(i % 7), i))]
    assert [r.doc_id for r in newest_places(docs).orderBy("place").collect()] == want
    assert [r.place for r in newest_places(docs).orderBy("place").collect()] == list(range(1, 51))

    def vector(text):
        if "poison" in text:
            raise RuntimeError("too hot")
        return [1.0, 2.0]

    text = "A sentence that is long enough to be a chunk of its own. "
    files = spark.createDataFrame([("a", "a.txt", 1, T0, text * 3), ("b", "b.txt", 1, T0, text + "Here is some poison in it."), ("c", "c.txt", 1, T0, None)],
                                  "doc_id string, filename string, file_size_bytes long, upload_date timestamp, text string")
    dims = spark.createDataFrame([("language", "Language", True, 1)], "dimension_id string, display_name string, is_multi_label boolean, dim_order int")
    cats = spark.createDataFrame([("language", "en")], "dimension_id string, name string")
    t = ingest(files, dims, cats, IngestOptions(encoder=hooks.guarded(vector, "array<double>")))
    rows = {r.doc_id: (r.status, r.error_message) for r in t["catalog"].collect()}
    assert rows["a"] == ("completed", None) and rows["b"] == ("failed", "RuntimeError: too hot") and rows["c"][0] == "failed"
    assert all({r.doc_id for r in t[n].select("doc_id").collect()} == {"a"} for n in ("doc_text", "pages", "chunks", "vectors", "postings"))


def test_compaction_of_ingested_batches(spark, tmp_path):
    from docspark.streaming import ingest as SI

    kind = "doc_id string, filename string, file_size_bytes long, upload_date timestamp, text string"
    dims = spark.createDataFrame([("language", "Language", True, 1)], "dimension_id string, display_name string, is_multi_label boolean, dim_order int")
    cats, out = spark.createDataFrame([("language", "en")], "dimension_id string, name string"), str(tmp_path / "corpus")
    for n, rows in enumerate([[("a", "The first text of a is here now."), ("b", "The only text of b is here now.")], [("a", "The second text of a, which is another.")]]):
        SI.ingest_batch(spark.createDataFrame([(i, f"{i}.txt", 1, at(n), t) for i, t in rows], kind), n, out, dims, cats)
    before = {n: sorted(map(str, df.collect())) for n, df in SI.read_tables(spark, out).items()}
    SI.compact(spark, out)
    SI.ingest_batch(spark.createDataFrame([("b", "b.txt", 9, at(9), "not taken twice")], kind), 1, out, dims, cats)
    assert {n: sorted(map(str, df.collect())) for n, df in SI.read_tables(spark, out).items()} == before
    assert Snapshots(spark, out).read()["tables"]["chunks"] == ["chunks/part=c1/batch=1"]
    assert [r.text for r in SI.read_tables(spark, out)["doc_text"].where("doc_id = 'a'").collect()] == ["The second text of a, which is another."]


def test_last_rows_are_a_table(spark, tmp_path):
    """No Python per document; last rows are folded with the counts, and a row folded away is not counted again."""
    out = str(tmp_path / "live")
    last = []
    for n, (i, minute, tags) in enumerate([("a", 5, ["x"]), ("b", 1, ["x", "y"]), ("a", 4, ["old"]), ("a", 6, ["z"]), ("a", 6, ["z"])]):
        rows = spark.createDataFrame([(i, at(minute), "completed", None, tags), (i, at(0), "failed", None, tags)], KIND)
        new = L.catalog_rows(rows).groupBy("doc_id").agg({"row": "max"}).withColumnRenamed("max(row)", "row")
        newer = L.newer_rows(new, Snapshots(spark, out).table("last", None, new.schema))
        plan = L.signed_rows(newer)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan
        L.save_changes(L.signed_rows(newer), n, out, folders=2, last=newer.select("doc_id", "row"))
        last.append({r.tag: r.n for r in L.live_tags(spark, out).collect()})
    assert last == [{"x": 1}, {"x": 2, "y": 1}, {"x": 2, "y": 1}, {"x": 1, "y": 1, "z": 1}, {"x": 1, "y": 1, "z": 1}]
    assert len(Snapshots(spark, out).read()["tables"]["last"]) <= 2
