import random
import zlib

import numpy as np

from glyphstream.llm import queries, trees


def plain_margin(forest, row):
    """One row down each tree, node by node."""
    total = forest.base
    for statistic, threshold, leaf in zip(forest.statistic, forest.threshold, forest.leaf):
        at = 0
        while at < len(statistic):
            at = 2 * at + (2 if row[statistic[at]] > threshold[at] else 1)
        total += leaf[at - len(statistic)]
    return total


def test_traversal_equals_a_walk():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(600, 5)).round(1)  # ties
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    forest = trees.grow(x, y, np.ones(600), trees.Settings(trees=30, depth=3))
    assert np.allclose(forest.margins(x), [plain_margin(forest, r) for r in x])
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.95


def test_first_split_is_the_best_of_all():
    draw = np.random.default_rng(2)
    x, y, w = draw.integers(0, 9, size=(300, 4)).astype(float), draw.integers(0, 2, 300).astype(float), np.ones(300)
    s = trees.Settings(trees=1, depth=1, ridge=1.0, least=1.0)
    forest = trees.grow(x, y, w, s)
    p = 1 / (1 + np.exp(-forest.base))
    g, h = p - y, np.full(300, p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
    best = max(gain(x[:, j] <= c) for j in range(4) for c in range(8))
    assert np.isclose(gain(x[:, forest.statistic[0, 0]] <= forest.threshold[0, 0]), best)


def test_one_label_or_none():
    x = np.zeros((4, 3))
    assert trees.grow(x[:0], np.zeros(0), np.zeros(0)).scores(x).tolist() == [0.5] * 4
    assert (trees.grow(x, np.ones(4), np.ones(4)).scores(x) > 0.8).all()


def test_statistics_of_odd_texts():
    for t in [None, "", " \n\t"]:
        assert not trees.statistics(t).any()
    for t in ["x", "é", "漢字 😀", "a" * 1_000_000, "a " * 300_000, "\n" * 1000 + "z", "\x00\x7f", "  q"]:
        got = trees.statistics(t)
        assert got.shape == (len(trees.NAMES),) and np.isfinite(got).all()
    named = dict(zip(trees.NAMES, trees.statistics("Go! go go\nGo! go\n| 12")))
    assert named["words"] == np.log1p(7) and named["lines"] == np.log1p(3) and named["distinct_lines"] == 1
    assert np.isclose(named["distinct_words"], 4 / 7) and np.isclose(named["top_word"], 3 / 7) and np.isclose(named["ends_loud"], 2 / 7)


def test_labels_that_are_held_out_or_odd_are_not_learnt(spark):
    docs = [(i, "Plain words of a text, and more of them." if i % 2 else "$$$ ### %%% &&&", f"q{i}", 0.0) for i in range(60)] + [(None, "no id", "q", 0.0), (3, None, "q", 0.0), (61, None, "q", 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, score double")
    flip = lambda i: zlib.crc32(str(i).encode()) % 5 == 0  # noqa: E731  wrong labels of held-out rows change nothing
    rows = [(i, (i % 2) ^ flip(i)) for i in range(60)] + [(None, 1), (5, None), (999, 0), (4, 7)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    clean = spark.createDataFrame([r for r in rows if r[0] is not None and not flip(r[0])], "doc_id long, quality int")
    one, two = (trees.score(df, trees.learn_from(df, x)).collect() for x in (labels, clean))
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == len(docs)
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in one if r.doc_id is not None and r.doc_id not in (3, 61))
    empty = trees.score(df, trees.learn_from(df, labels.limit(0))).collect()
    assert {r.score for r in empty} == {0.5}
    assert trees.score(df.limit(0), trees.learn_from(df.limit(0), labels)).count() == 0


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op12_quality_trees(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows.keys() == docs.keys() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert sum(rows[r.doc_id].predicted == r.quality for r in labels) / len(labels) >= 0.9
    # the query's scores are those of its forest, row by row
    forest = trees.learn_from(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    for i in random.Random(1).sample(sorted(docs), 40):
        assert np.isclose(1 / (1 + np.exp(-plain_margin(forest, trees.statistics(docs[i])))), rows[i].score)
