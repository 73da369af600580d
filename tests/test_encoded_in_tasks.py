"""Texts that counting tasks encode themselves against sequences encoded by Spark's functions, and passes of the queries."""

import random

import numpy as np
import pytest

from glyphstream.functions import sequence as q
from glyphstream.operators import sparse, tokens
from glyphstream.plans import audits, queries, summaries  # noqa: F401
from glyphstream.plans.queries import QUERIES, F
from glyphstream.sources.catalogue import Catalogue

SF = "/root/testdata/sf0.001"
ODD = [None, "", "-", "\x00a\x7fB\n", "é", "Kİab", "😀abc-12", "0123456789", "aAé" * 50, "--a--b", "The quick brown fox, 42 times.", "".join(map(chr, range(1, 300)))]


def plan(name, spark):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def both(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id int, text string")
    return df.select("id", q.encoded(F.col("text")).alias("s")), df.select("id", F.col("text").cast("binary").alias("s"))


def test_bytes_are_encoded_like_columns(both):
    assert [r.s or "" for r in both[0].orderBy("id").collect()] == [q.encoded_bytes(None if x is None else x.encode()) for x in ODD]


def test_counts_of_bytes_and_of_sequences(both):
    by = [tokens.tokenizer(n) for n in ("overlap_k2", "codon", "overlap_k5")]
    for count in (lambda df: tokens.row_counts(df, by, ["id"]), lambda df: tokens.group_counts(df, by, []), lambda df: tokens.vectors(df, by[0], ["id"]), lambda df: tokens.row_measures(df, by, ["id"], dense=by[0])):
        one, two = (sorted(map(str, count(df).collect())) for df in both)
        assert one == two and one


def test_symbols_and_dense_counts(both):
    rows = {r.id: r for r in tokens.row_measures(both[1], [tokens.tokenizer("overlap_k3")], ["id"], letters=q.SYMBOLS, dense=tokens.tokenizer("overlap_k2")).collect()}
    for i, text in enumerate(ODD):
        s = q.encoded_bytes(None if text is None else text.encode())
        assert rows[i].counts == [sum(s[j : j + 2] == a + b for j in range(len(s))) for a in q.SYMBOLS for b in q.SYMBOLS]
        assert rows[i].symbols == (None if text is None else (len(s), *(s.count(x) for x in q.SYMBOLS)))


def test_wide_metric_rows_take_one_pass_of_tasks_over_the_text(spark):
    shown = plan("sequence_metric_rows", spark)
    assert shown.count("MapInArrow ") == 1 and "translate(" not in shown and "regexp_replace(" not in shown


def test_tfidf_rows_are_encoded_in_tasks(spark):
    shown = plan("tfidf_matrix", spark)
    assert "translate(" not in shown and "regexp_replace(" not in shown


def test_small_tables_and_sorting_count_alike():
    draw = random.Random(5)
    texts = ["".join(draw.choice("ACGTN-\n") for _ in range(n)) for n in (3000, 0, 1, 2000, 7)]
    specs = [tokens.tokenizer(n) for n in ("overlap_k2", "overlap_k3", "codon", "frame2_k3")]
    few = tokens.counted(texts, np.arange(5), specs)
    one = [tokens.counted(texts, np.arange(5), [t])[0] for t in specs]  # without longer tokens beside them
    far = tokens.counted(texts, np.arange(5) * 100_000, specs)  # numbers too far apart for a table
    for a, b, c in zip(few, one, far):
        assert a[3] == b[3] == c[3] and all((a[i] == b[i]).all() for i in range(3)) and (a[0] * 100_000 == c[0]).all() and (a[2] == c[2]).all()


def test_centroids_take_one_pass_over_the_rows(spark):
    rows = spark.createDataFrame([("a", [0, 1], [0.5, 0.5]), ("a", [1], [1.0]), ("a", [], []), (None, [0], [1.0])], "g string, at array<int>, value array<double>")
    assert sorted(map(tuple, sparse.centroids(sparse.Matrix(rows, "id", ["x", "y"]), "g").collect())) == [("a", "x", 0.25), ("a", "y", 0.75)]
    shown = plan("top_features", spark)
    assert shown.count("MapInArrow ") == 1 and "translate(" not in shown


def test_summaries_and_distances_encode_in_tasks_and_distances_count_once(spark):
    got = {r.id: r.symbols for r in tokens.symbol_counts(spark.createDataFrame([(1, None), (2, ""), (3, "ACCT-N")], "id int, s string"), ["id"]).collect()}
    assert got == {1: None, 2: (0, 0, 0, 0, 0), 3: (6, 1, 2, 0, 1)}
    assert "MapInArrow" not in plan("js_distance_k3", spark)  # its sides read stored counts


def test_loading_a_view_does_not_make_it_again(spark, tmp_path):
    made = []
    views = Catalogue({"v": lambda: made.append("v") or spark.range(3)})
    views.export(str(tmp_path))
    assert views.load(spark, str(tmp_path), "v").count() == 3 and made == ["v"]
    assert Catalogue(views.views).load(spark, str(tmp_path), "v").columns == ["id"] and made == ["v", "v"]  # one that didn't export asks for the columns
