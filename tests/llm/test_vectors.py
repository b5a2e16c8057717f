"""Vector operators against brute force, with nulls, zeros, ties and copies."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm.top_products import top_products
from docspark.llm.vector_dups import near_vectors

DDL = "vec_id long, embedding array<float>, label int, kept string"


def brute_links(rows, least):
    links = {r[0]: set() for r in rows}
    unit = {}
    for i, v, label, *_ in rows:
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = np.array(v, np.float32).astype(float)
            unit[i] = (label, v / np.linalg.norm(v))
    for a in unit:
        for b in unit:
            if a != b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= least:
                links[a].add(b)
    least_of = {}
    for i in sorted(links):
        seen, todo = {i}, [i]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        least_of[i] = min(seen)
    return {i: (len(x), least_of[i]) for i, x in links.items()}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    rows = []
    for c in range(40):
        centre = rng.standard_normal(16)
        for k in range(int(rng.integers(1, 12))):
            v = centre + rng.standard_normal(16) * 0.16 * rng.random()
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(c % 3), "x"))
    rows += [(900 + k, rows[3][1], rows[3][2], "copy") for k in range(30)]
    rows += [(990, None, 1, None), (991, [0.0] * 16, 1, None), (992, [float("nan")] + [1.0] * 15, 1, None), (993, [], 1, None),
             (994, [None] + [1.0] * 15, 1, None), (995, rows[3][1], None, None), (996, [float("inf")] + [1.0] * 15, 1, None), (997, [1.0, 2.0], 0, None)]
    return rows


def test_near_vectors_matches_brute_force(spark, vectors):
    got = {r["vec_id"]: r for r in near_vectors(spark.createDataFrame(vectors, DDL), 0.98).collect()}
    want = brute_links(vectors, 0.98)
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_small_blocks_give_the_same_links(spark, vectors):
    got = near_vectors(spark.createDataFrame(vectors, DDL), 0.98, block=4).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_links(vectors, 0.98)


def test_no_vectors(spark):
    assert near_vectors(spark.createDataFrame([], DDL)).count() == 0
    only = near_vectors(spark.createDataFrame([(1, None, None, None)], DDL)).collect()
    assert [tuple(r) for r in only] == [(1, 0, 1, True)]


def brute_top(rows, asked, k):
    out = []
    for q, v in asked:
        hits = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0, 3])
def test_top_products_matches_brute_force(spark, spread):
    rng = np.random.default_rng(spread)
    rows = [(i, [int(x) for x in rng.integers(-9, 10, 8) * (1 + spread * (i % 7))]) for i in range(3000)]
    rows += [(4000 + i, rows[5][1]) for i in range(40)] + [(5000, [0] * 8)]
    df = spark.createDataFrame(rows + [(6000, None), (6001, [None] * 8)], "vec_id long, vec array<long>").withColumn("score", F.lit("clash"))
    asked = [r for r in rows if r[0] % 50 == 0]
    got = top_products(df, df.where("vec_id % 50 = 0"), 20)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, asked, 20)


def test_top_products_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [-3, 1]), (2, [0, 0])], "vec_id long, vec array<long>")
    assert sorted(map(tuple, top_products(df, df, 20).collect())) == brute_top([(0, [1, 2]), (1, [-3, 1]), (2, [0, 0])], [(0, [1, 2]), (1, [-3, 1]), (2, [0, 0])], 20)
    assert top_products(df.limit(0), df, 20).count() == 0
