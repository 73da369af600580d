import math
import random

import numpy as np

from glyphstream.llm import topk


def plain(rows, k, every):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q in {i for i, _ in sound if i % every == 0}:
        vector = min(v for i, v in sound if i == q)
        scores = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in sound if i != q and len(v) == len(vector))
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_matches_plain_search(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(20)]) for i in range(300)]
    rows += [(i, rows[i % 40][1]) for i in range(300, 420)] + [(10, rows[10][1]), (10, rows[11][1])]
    rows += [(500, None), (None, rows[0][1]), (510, [None] * 20), (520, [float("nan")] * 20), (530, [float("inf")] + [0.0] * 19), (540, [1.0, 2.0]), (541, [3.0, 4.0]), (550, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(6)
    got = {}
    for r in topk.top_k(df, lambda i: i % 10 == 0, 5, least=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    want = {q: v for q, v in plain(rows, 5, 10).items() if v}
    assert got == want
    assert topk.top_k(df.limit(0), lambda i: i % 10 == 0, 5).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    q, x = rng.integers(-200, 200, (2, 30, 18)).astype(float)
    product = q @ x.T
    for a, b in zip(topk.summaries(q), topk.summaries(x)):
        assert (a @ b.T >= product - 1e-6).all()


def test_large_components_stay_exact():
    q, x = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0]])
    assert topk.exact(q, x).tolist() == [[2**60 + 1]]


def test_bounds_prune_where_vectors_have_structure():
    """Most pairs of smooth vectors about few centres go by the bounds; the results stay those of all products."""
    rng = np.random.default_rng(5)
    centres = np.cumsum(rng.normal(0, 40, (20, 64)), axis=1)
    x = np.floor(centres[rng.integers(0, 20, 3000)] + rng.normal(0, 4, (3000, 64)))
    ids, q_ids, left = np.arange(3000), np.arange(0, 3000, 50), np.zeros(5, np.int64)
    rows, found, scores = topk.search_block(q_ids, x[q_ids], ids, x, 5, left)
    assert left[-1] < 0.1 * left[0] and all(a >= b for a, b in zip(left, left[1:]))
    for i, query in enumerate(q_ids):
        want = sorted((-int(x[query] @ x[j]), j) for j in ids if j != query)[:5]
        assert [(-s, j) for s, j in zip(scores[rows == i].tolist(), found[rows == i].tolist())] == want
