"""Each stage of the corpus pipeline against brute force, on its own input."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from docspark.llm.queries import tokenizer_path

from .test_texts import brute_classes, brute_cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeghilnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, texts, toxic = text(60), [], []
    for i in range(400):
        t = text(rng.randint(8, 90))
        if i % 11 == 3:
            t += " " + passage + " " + text(6)
        if i % 13 == 5 and i > 20:
            t = texts[i // 2]
        if i % 17 == 6:
            w = texts[i - 2].split()
            w[0] = "changed"
            t = " ".join(w)
        texts.append(t)
        toxic.append(i % 7 == 2)
    texts = [f"{t[:20]} horridword vileword {t}" if x else t for t, x in zip(texts, toxic)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)] + [(400, None, None, "src0", None), (401, "", "en", None, 0), (None, text(30), "en", "src1", 9)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    marks = [(i, int(i % 3 > 0), int(x)) for i, x in enumerate(toxic) if i % 2] + [(7, None, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf_dir, tmp_path):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "mixing", "tokens"] and P.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = (before.collect(), docs.collect())
        if name != "tokens":
            assert docs.columns == COLUMNS
    before, after = kept["toxicity"]
    assert sorted(map(str, after)) == sorted(str(r) for r in before if "vileword" not in (r["text"] or ""))
    before, after = kept["near_duplicates"]
    classes = brute_classes([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None], 5, 80)
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r["doc_id"] is None or classes[r["doc_id"]][1] == r["doc_id"])
    before, after = kept["repeated_passages"]
    want = brute_cut([(10**9 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in before])
    assert len(after) == len(before) and any(x[1] for x in want.values())
    for r in after:
        assert hashlib.sha256(r["text"].encode()).hexdigest() == want[10**9 if r["doc_id"] is None else r["doc_id"]][2] and r["n_chars"] == len(r["text"])
    before, after = kept["mixing"]
    assert {str(r) for r in after} == {str(r) for r in before} and len(before) <= len(after)
    before, after = kept["tokens"]
    library = Tokenizer.from_file(tokenizer_path())
    ids = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in before}
    assert len(after) == len(before)
    for r in after:
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids[r["doc_id"]] and r["n_tokens"] == len(ids[r["doc_id"]])


def test_run_on_empty_documents(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).where(F.lit(True)).count() == 0


def test_nothing_is_rejected_without_labels(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert P.toxicity(spark, docs, str(tmp_path)).count() == docs.count()
