"""The Merkle manifest against a plain recursive one."""
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docspark.llm import merkle
from docspark.llm.merkle import fold, manifest, path_digest
from docspark.llm.queries import QUERIES

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
DOCS = "doc_id long, source string, lang string, n_chars long, text string, path string, tree string, root string, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def grow(digests):
    """(root, proof of each): proofs are lists of (left, right)."""
    proofs, spots, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, k in enumerate(spots):
            a = k // 16 * 16
            proofs[i].append(("".join(level[a:k]), "".join(level[k + 1:a + 16])))
        level = [h(*level[a:a + 16]) for a in range(0, len(level), 16)]
        spots = [k // 16 for k in spots]
    return level[0], proofs


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = grow([leaf(r) for r in by[s]])
    root, tops = grow([trees[s][0] for s in names])
    for s, top in zip(names, tops):
        for r, own in zip(by[s], trees[s][1]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = r[4] if r[4] is None or not bad else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            acc = leaf((*r[:4], text))
            for a, b in own + top:
                acc = h(a, acc, b)
            out.append((r[0], leaf(r), trees[s][0], root, h(*[a + b for a, b in own + top]), acc, acc == root))
    return out


def rows_of(n, rng):
    sizes = [n, 300, 257, 256, 17, 16, 15, 2] + [1] * 12
    rows, doc = [], 0
    for k, size in enumerate(sizes):
        source = None if k == 4 else "" if k == 5 else "é" if k == 6 else f"src{k}"
        for _ in range(size):
            doc += rng.randint(1, 3)
            text = rng.choice([None, "", "low", "Some TEXT é", "ÄÖ", "x" * 3000 + "Y"])
            rows.append((doc, source, rng.choice(["en", None]), rng.choice([None, 7]), text))
    rows += rows[5:9] + [(None, "src0", None, None, None), (-5, "src1", "en", 1, "A"), (-5, "src1", "en", 1, "B")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [1, 2])
def test_manifest(spark, monkeypatch, tmp_path, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 16 ** height)
    rows = rows_of(600, random.Random(height))
    docs = spark.createDataFrame([(*r, "p", "t", "r", "l") for r in rows], DOCS)
    docs.repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_merkle_manifest"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = [tuple(r) for r in got.collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_paths_are_handed_out(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2}", None, None, str(i)) for i in range(40)], DOCS.split(", path")[0])
    got = manifest(docs, COLUMNS, "source", "doc_id")
    assert {"doc_id", "source", "leaf", "subroot", "root", "path", "claim"} == set(got.columns)
    same = got.select((fold(F.col("claim"), F.col("path")) == F.col("root")).alias("x"), (F.col("claim") == F.col("leaf")).alias("y")).distinct().collect()
    assert [tuple(r) for r in same] == [(True, True)]


def test_single_rows_and_none(spark):
    kind = DOCS.split(", path")[0]
    one = manifest(spark.createDataFrame([(None, None, None, None, None)], kind), COLUMNS, "source", "doc_id")
    r = one.withColumn("p", path_digest(F.col("path"))).collect()[0]
    assert r["leaf"] == r["subroot"] == r["root"] == h("-----") and r["path"] == [] and r["p"] == h() and r["source"] is None
    assert manifest(spark.createDataFrame([], kind), COLUMNS, "source", "doc_id").count() == 0
