"""Hard negatives against brute force."""
import numpy as np
import pytest

from docspark.llm import hard_negatives as H
from docspark.llm.hard_negatives import Cells, best_rows, half_codebook, hard_negatives
from docspark.llm.queries import QUERIES

KIND = "vec_id long, label int, vec array<double>, page string, id string, marks int"


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    def clean(table):
        best = {}
        for i, g, v in table:
            if i is not None and g is not None and v and all(x is not None for x in v):
                best[i] = max(best.get(i, (v, str(g))), (v, str(g)))
        return best

    pool, out = clean(rows), []
    for a, (va, ga) in clean(anchors).items():
        scored = sorted(((-int(np.dot(va, v)), i, g) for i, (v, g) in pool.items() if i != a))
        near = [(i, -s) for s, i, g in scored if g == ga][:positives]
        for p, ps in near:
            hits = [(i, -s) for s, i, g in scored if g != ga and low * ps <= -100 * s <= high * ps]
            out += [(a, p, r + 1, i, ps, s) for r, (i, s) in enumerate(hits[:negatives])]
    return sorted(out)


def clustered(n, dim, rng, copies=0):
    centres = rng.normal(size=(8, dim)) * 40
    vecs = np.floor(centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dim)) * 25)
    rows = [(i, int(g), v.tolist()) for i, (g, v) in enumerate(zip(rng.integers(0, 5, n), vecs))]
    rows += [(n + k, rows[3][1] if k % 3 else 4, rows[3][2]) for k in range(copies)]
    return rows


@pytest.mark.parametrize("dim, small", [(16, False), (16, True), (7, True), (1, True)])
def test_against_brute_force(spark, monkeypatch, dim, small):
    if small:
        for name, value in (("PAGE", 60), ("CELL", 4), ("ACROSS", 2), ("SAMPLE", 200), ("SEEDS", 40), ("STREAM", 9)):
            monkeypatch.setattr(H, name, value)
    rows = clustered(600, dim, np.random.default_rng(dim), copies=70)
    odd = [(None, 1, [1.0] * dim), (9001, None, [1.0] * dim), (9002, 1, None), (9003, 1, []), (9004, 1, [None] * dim), (9005, 2, [0.0] * dim),
           (5, 1, [2.0] * dim), (5, 1, [2.0] * dim)]
    rows += odd
    df = spark.createDataFrame([(*r, "p", "i", 1) for r in rows], KIND)
    asked = [r for r in rows if r[0] is not None and r[0] % 15 == 0] + odd[1:6] + [(70_000, 2, rows[8][2])]
    got = hard_negatives(df, spark.createDataFrame([(*r, "p", "i", 1) for r in asked], KIND))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, asked)
    assert sorted(tuple(r) for r in got.collect()) == want and (want or dim == 1)


def test_other_numbers_and_nothing(spark):
    rows = clustered(120, 4, np.random.default_rng(2))
    df = spark.createDataFrame([(*r, "p", "i", 1) for r in rows], KIND)
    got = hard_negatives(df, df.where("vec_id < 9"), positives=2, negatives=7, low=10, high=80)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, rows[:9], 2, 7, 10, 80)
    none = spark.createDataFrame([], KIND)
    assert hard_negatives(none, df).count() == 0 and hard_negatives(df, none).count() == 0
    with pytest.raises(ValueError):
        hard_negatives(df, spark.createDataFrame([(1, 1, [1.0], None, None, None)], KIND))


def test_query(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, int(g), (v / np.linalg.norm(v)).tolist()) for i, (g, v) in enumerate(zip(rng.integers(0, 10, 400), rng.normal(size=(400, 6)) + 0.4))]
    odd = [(1000, 1, None), (1050, None, [0.1] * 6), (1100, 2, [float("nan")] * 6), (1150, 2, [float("inf")] * 6), (1200, 3, [None] * 6), (1250, 3, [0.0] * 6)]
    spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in QUERIES["op12_hard_negatives"](spark, str(tmp_path)).collect())
    whole = [(i, (g + 1) % 10 if i % 7 == 0 else g, np.floor(256 * np.float32(v).astype(float)).tolist()) for i, g, v in rows + odd[-1:]]
    assert got == brute(whole, [r for r in whole if r[0] % 50 == 0]) and got


def test_the_walk_visits_every_row_once_by_falling_bound():
    rng = np.random.default_rng(3)
    vecs = rng.integers(-50, 50, (500, 9)).astype(float)
    books = [half_codebook(vecs[:, :4], 12), half_codebook(vecs[:, 4:], 12)]
    cells = Cells(np.arange(500), np.zeros(500, object), vecs, books)
    query = rng.integers(-50, 50, 9).astype(float)
    seen, before, visited = [], np.inf, 0
    for up, low, a, b in cells.walk(query):
        scores = cells.vecs[a:b] @ query
        assert up <= before + 1e-9 and (scores <= up).all() and (scores >= low).all()
        before = up
        seen += cells.ids[a:b].tolist()
    assert sorted(seen) == list(range(500))
    ids, scores = best_rows(cells, query, -1, 5, -np.inf)
    want = np.lexsort((cells.ids, -(cells.vecs @ query)))[:5]
    assert ids.tolist() == cells.ids[want].tolist()
