import itertools
import random
from zlib import crc32

import numpy as np
import pytest

from glyphstream.llm import toxicity as t


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    x, lengths = rng.normal(size=(4, 3)), np.array([4, 2, 1])
    start, trans = 0.3, rng.normal(size=(2, 2))
    got, pairs = t.forward_backward(x, lengths, start, trans)
    model = t.Model(start=start, trans=trans)
    want_pairs = np.zeros((2, 2))
    for j, n in enumerate(lengths):
        weight, toxic = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(start * path[0] + sum(x[i, j] * path[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            weight, toxic = weight + w, toxic + w * np.array(path)
        assert np.allclose(got[:n, j], toxic / weight)
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(start * path[0] + sum(x[i, j] * path[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(path, path[1:]))) / weight
            for a, b in zip(path, path[1:]):
                want_pairs[a, b] += w
        assert np.allclose(t._marginals(x, lengths, model)[:n, j], toxic / weight)
    assert np.allclose(pairs, want_pairs)


def made(n):
    rng = random.Random(6)
    plain = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(10, 60))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["Nasty", "vile", "AWFUL"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = made(900)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    return t.learn_from(df, marks), docs, labels


def test_held_out_accuracy(spark, model):
    fitted, docs, labels = model
    df = spark.createDataFrame([(i, x, 2.0) for i, x in docs], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in t.score(df, fitted).collect()}
    right = [(got[i].score >= 0.7) == bool(y) for i, y in labels if crc32(str(i).encode()) % 3 == 1]
    assert len(right) > 200 and sum(right) / len(right) > 0.98
    texts = dict(docs)
    for r in got.values():
        assert all(texts[r.doc_id][s.start : s.end].lower() in ("nasty", "vile", "awful") for s in r.toxic_spans if s.marginal > 0.9)
    flags = {r.doc_id: r.h for r in df.select("doc_id", t.held_out().alias("h")).collect()}
    assert all(flags[i] == (crc32(str(i).encode()) % 3 == 1) for i, _ in docs)


def test_edge_rows(spark, model):
    fitted = model[0]
    long = "worda " * 30000 + "vile"
    rows = [(1, None), (2, ""), (3, "123 --"), (4, long), (5, "İİ vile"), (5, "İİ vile"), (None, "fine")]
    got = t.score(spark.createDataFrame(rows, "doc_id long, text string"), fitted).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].score == by[2].score == by[3].score < 0.5
    assert [(s.start, s.end) for s in by[4].toxic_spans] == [(180000, 180004)] and [(s.start, s.end) for s in by[5].toxic_spans] == [(3, 7)]
    assert all(0 <= r.score <= 1 for r in got)
    assert t.score(spark.createDataFrame([], "doc_id long, text string"), fitted).count() == 0
    none = t.learn_from(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in t.score(spark.createDataFrame(rows, "doc_id long, text string"), none).collect()} == {0.5}
