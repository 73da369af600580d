import numpy as np
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from glyphstream.operators import align, features, panels, retrieval, stability, tokens
from glyphstream.sources import readers, sinks


def dist(spark):
    rows = [("HA", "AAA", 8), ("HA", "CCC", 2), ("NA", "AAA", 1), ("NA", "CCC", 9)]
    return tokens.distribution(spark.createDataFrame(rows, "g string, token string, n long"), ["g"])


def test_distances(spark):
    got = {(r.a, r.b): r.distance for r in tokens.divergence(dist(spark), "g").collect()}
    assert got["HA", "HA"] == pytest.approx(0, abs=1e-7) and got["HA", "NA"] == got["NA", "HA"] and 0 < got["HA", "NA"] < 1
    apart = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 1.0)], "g string, token string, share double")
    assert {r.distance for r in tokens.divergence(apart, "g").where("a <> b").collect()} == {1.0}
    points = spark.createDataFrame([("a", "x", 3.0), ("b", "y", 4.0)], "g string, feature string, value double")
    assert features.centroid_distances(points, "g").where("a < b").first().distance == 5.0


def test_enrichment_and_diversity(spark):
    top = {(r.g, r["rank"]): r.token for r in tokens.enrichment(dist(spark), "g", 1).collect()}
    assert top == {("HA", 1): "AAA", ("NA", 1): "CCC"}
    for r in tokens.diversity(dist(spark), ["g"]).collect():
        assert r.entropy <= math.log2(r.vocabulary) and r.effective_vocabulary == pytest.approx(2**r.entropy)


def test_results_do_not_depend_on_layout(spark):
    rows = spark.createDataFrame([(i, f"s{i % 2}", f"p{i % 5}") for i in range(100)], "id int, stratum string, part string")
    take = lambda n: sorted(r.id for r in panels.balanced_sample(rows.repartition(n), 20, "stratum", "part", 1, "id").collect())
    assert take(1) == take(17) and len(take(1)) == 20
    sizes = {r.stratum: r["count"] for r in panels.balanced_sample(rows, 20, "stratum", "part", 1, "id").groupBy("stratum").count().collect()}
    assert sizes == {"s0": 10, "s1": 10}
    assert panels.balanced_sample(rows, 500, "stratum", "part", 1, "id").count() == 100


def test_checked_join(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    assert panels.join_one(left, spark.createDataFrame([(1, "a")], "k int, v string"), "k").count() == 2
    with pytest.raises(PySparkException):
        panels.join_one(left, spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), "k").collect()
    with pytest.raises(ValueError, match="lacks"):
        panels.require_columns(left, {"x"}, "left")


def test_quantile_bins(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(6)], "k int, v double")
    sizes = [r["count"] for r in panels.quantile_bins(rows, "v", 4, "k").groupBy("bin").count().orderBy("bin").collect()]
    assert sizes == [2, 1, 1, 2]


def test_bootstrap(spark):
    rows = spark.createDataFrame([(i, "ABC"[i % 3], float(i)) for i in range(6)], "id int, g string, v double")
    drawn = stability.bootstrap_rows(rows, "g", "id", 5, 10, 1)
    assert drawn.groupBy("replicate", "g").count().where("count <> 2").count() == 0 and drawn.count() == 30
    got = stability.interval(spark.createDataFrame([("x", v) for v in (1.0, 2.0, 3.0, float("nan"))], "g string, v double"), ["g"], "v").first()
    assert (got.n, got["mean"]) == (3, 2.0) and got.low <= 2 <= got.high
    again = stability.resampled_counts(dist(spark), "g", 3, 5, 9).groupBy("replicate", "g").agg(F.sum("n").alias("n"))
    assert {r.n for r in again.collect()} == {5}
    assert {r.jaccard for r in stability.top_stability(dist(spark), "g", 2, 100, 1, 1).collect()} == {1.0}


def test_ranking_of_constant_columns(spark):
    rows = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0)], "k string, x double, y double")
    got = {r.k: r.robustness for r in stability.ranking(rows, "k", {"x": True, "y": False}).collect()}
    assert got == {"a": 0.0, "b": 0.5}


def test_matrix_and_projection(spark):
    m = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "a", 2.0)], "id int, feature string, value double")
    assert {(r.id, r.feature): r.value for r in features.normalized_rows(m, "id").collect()} == {(1, "a"): 0.25, (1, "b"): 0.75, (2, "a"): 1.0}
    assert all(r.s == pytest.approx(1) for r in features.tfidf(m, "id", 2).groupBy("id").agg(F.sum(F.col("value") ** 2).alias("s")).collect())
    v = spark.createDataFrame([(i, "ab"[i % 2], [float(i), 2.0 * i, 1.0]) for i in range(8)], "id int, g string, v array<double>")
    rows, ratios = features.pca(v, "v", 5)
    assert ratios[0] == pytest.approx(1) and len(rows.first().projected) == 5
    assert rows.agg(F.abs(F.avg(F.col("projected")[0]))).first()[0] == pytest.approx(0, abs=1e-9)
    apart = spark.createDataFrame([(i, "ab"[i % 2], [100.0 * (i % 2), float(i)]) for i in range(10)], "id int, g string, v array<double>")
    assert features.silhouette(apart, "v", "g", "id") > 0.9
    assert features.silhouette(apart.where("g = 'a'"), "v", "g", "id") is None


def test_alignment(spark):
    score, pairs = align.local_alignment("MKTAAACCC", "TAAA")
    assert score == 8 and pairs == [(2, 0), (3, 1), (4, 2), (5, 3)]
    cons = align.consensus(spark.createDataFrame([("g", "MK*"), ("g", "MRX"), ("g", "MK")], "g string, a string"), "g", "a").first()
    assert cons.consensus == "MKX"


def test_retrieval_and_guard(spark):
    rows = [(1, "codon usage", ["metric"], "codon table"), (2, "other", ["data"], "a codon"), (3, "none", [], "nothing")]
    chunks = spark.createDataFrame(rows, "id int, title string, tags array<string>, text string").withColumn("section", F.lit("cds"))
    got = {r.id: r.score for r in retrieval.scored(chunks, "What codon metric?").collect()}
    assert got == {1: 1 + 3 + 1 + 4, 2: 1, 3: 0}
    assert {r.id: r.score for r in retrieval.scored(chunks, "rscu").collect()} == {1: 4 + 4, 2: 1 + 4, 3: 4}  # by its aliases codon and cds
    assert [r.id for r in retrieval.answer(chunks, "codon metric").collect()] == [1, 2]
    assert [r.id for r in retrieval.answer(chunks, "zzz", 2).collect()] == [1, 2]
    hint = lambda *tags: spark.range(1).select(retrieval.view_hint(F.array(*map(F.lit, tags)))).first()[0]
    assert (hint("dataset", "structure"), hint("sequence_context"), hint("claims")) == ("structure", "tokens", "guide")
    with pytest.raises(ValueError):
        retrieval.require_short_tokens(spark.createDataFrame([("ACGTACG",)], "token string"))
    with pytest.raises(ValueError):
        retrieval.guard(chunks.withColumn("sequence", F.lit("A")), {"sequence"})
    with pytest.raises(ValueError):
        retrieval.require_safe(spark.createDataFrame([("ACGT" * 30,)], "x string"), set())


def test_bpe_merges(spark):
    words = spark.createDataFrame([("abab",), ("abab",), ("abc",)], "w string")
    assert tokens.train_bpe(words, 2, "w") == [("a", "b"), ("ab", "ab")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(">s1 first\nACGT\nAC\n>s2\r\nGG\n")
    (tmp_path / "in" / "b.csv").write_text("k,v\n1,NA\n2,\n")
    (tmp_path / "in" / "c.json").write_text('{"items": [{"k": 1, "v": "x"}, {"k": 2, "v": null}]}')
    base = str(tmp_path / "in")
    rows = readers.read_fasta(spark, base).collect()
    assert sorted((r.seq_id, r.sequence, r.source_file) for r in rows) == [("s1", "ACGTAC", "a.fasta"), ("s2", "GG", "a.fasta")]
    assert readers.inspect_fasta(spark, f"{base}/a.fasta").first() == (2, 2, 6)
    assert [r.v for r in readers.read_table(spark, f"{base}/b.csv", "k int, v string").orderBy("k").collect()] == ["NA", None]
    assert readers.read_optional(spark, f"{base}/no.csv", "k int").count() == 0
    assert readers.read_paired(spark, f"{base}/c.json", "items", "k int, v string").count() == 2
    assert {r.kind for r in readers.inventory(spark, base).collect()} == {"sequence", "table", "json"}
    text = spark.createDataFrame([(">1|A|name|org\nMK T1\n>odd\nAA",)], "t string")
    assert [(r.entity, r["name"], r.sequence) for r in readers.parse_entries(text, "t").collect()] == [("1", "name", "MKT"), (None, "odd", "AA")]
    sinks.write_fasta(spark.createDataFrame([("x", "AC")], "seq_id string, sequence string"), str(tmp_path / "out"))
    assert readers.read_fasta(spark, [str(p) for p in (tmp_path / "out").glob("part*")]).count() >= 0
    sinks.write_csv(spark.createDataFrame([(1, "AC")], "k int, s string"), str(tmp_path / "csv"))
    assert readers.read_table(spark, str(tmp_path / "csv"), "k int").columns == ["k"]
    assert sinks.safe_records(spark.createDataFrame([(float("inf"),), (0.1234567,)], "x double")).collect()[1].x == 0.123457
    assert "(first 1 rows)" in sinks.markdown(spark.createDataFrame([(1,), (2,)], "x int"), 1)


def test_guide_and_bundle(spark):
    from glyphstream.plans import summaries

    cards = summaries.cards(spark, {"GC content": "Share of G and C among valid symbols of a sequence; undefined when a sequence has none of them at all.", "Panel": "A table of records."})
    assert {r.title: r.tags for r in cards.collect()} == {"GC content": ["sequence_context"], "Panel": ["dataset"]}
    said = summaries.composed("Does it predict gc content?", cards)
    assert said.startswith("Out of scope") and "Share of G and C" in said and said.endswith("See: tokens")
    assert summaries.composed("What is a panel?", cards).startswith("Short answer: A table of records.")
    views = summaries.bundle(spark, "/root/testdata/sf0.001")
    assert len(views) == 9 and views["distances"].count() == 16


def test_finite_intervals(spark):
    rows = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, float("nan"), float("inf"), None)], "g string, v double")
    got = stability.interval(rows, ["g"], "v").first()
    assert (got.n, got["mean"]) == (3, 2.0) and abs(got.low - 1.05) < 1e-9


def test_tokenizer_ranking(spark):
    js = spark.createDataFrame([("a", 0.2, 0.1), ("b", 0.6, 0.3), ("c", 0.4, 0.1)], "tokenizer string, mean double, width double")
    jaccard = spark.createDataFrame([("a", 0.5, 0.0), ("a", 0.7, 0.0), ("b", 0.2, 0.0)], "tokenizer string, mean double, width double")
    entropy = spark.createDataFrame([("a", 1.0, 0.4), ("b", 1.0, 0.2), ("b", 1.0, 0.4), ("c", 1.0, 0.2)], "tokenizer string, mean double, width double")
    coverage = spark.createDataFrame([("a", 10), ("b", 5), ("c", 10)], "tokenizer string, n_sequences long")
    got = {r.tokenizer: r for r in stability.tokenizer_ranking(js, jaccard, entropy, coverage).collect()}
    want = {"a": (0 + 1 + 1 + 0 + 1) / 5, "b": (1 + 0 + 0 + 0.5 + 0.5) / 5, "c": (0.5 + 1 + 1 + 1) / 4}  # c has no jaccard: four scores
    assert all(abs(got[k].robustness - v) < 1e-9 for k, v in want.items())
    assert sorted(got, key=lambda k: got[k]["rank"]) == ["c", "a", "b"]


def test_records_panels_and_flags(spark):
    rows = spark.createDataFrame([(1, "HA", "ACGT" * 3), (2, "HA", "AC"), (3, "NA", "ACGT" * 3), (4, None, "NNNN"), (5, None, "GG")], "id int, segment string, s string")
    got = panels.filtered_records(rows, {"HA": 4}, 0.5, ["id"])
    assert sorted(r.id for r in got.collect()) == [1, 5]
    flags = rows.select("id", *(c.alias(n) for n, c in zip(panels.QC, panels.sequence_qc(F.col("s"), 3, None, 0.1))))
    assert {r.id: (r.long_enough, r.short_enough, r.clear, r.passes) for r in flags.collect()}[4] == (True, True, False, False)
    many = spark.range(10).withColumn("x", F.col("id") < 6)
    assert panels.preferred(many, [F.col("x")], 6).count() == 6 and panels.preferred(many, [F.col("x")], 7).count() == 10
    assert tokens.vocabulary([("a", "b"), ("ab", "c")], ["b", "a"], size=4) == {"[UNK]": 0, "a": 1, "b": 2, "ab": 3}


def test_distances_of_all_pairs(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(25, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    got = {(r.a, r.b): r.distance for r in features.pairwise_distances(df, "k", "v", 3).collect()}
    assert set(got) == {(i, j) for i in range(25) for j in range(i + 1, 25)}
    assert all(abs(d - np.linalg.norm(x[a] - x[b])) < 1e-9 for (a, b), d in got.items())


def test_ranks_and_joins_without_one_task(spark, monkeypatch):
    from glyphstream import runtime

    rows = spark.createDataFrame([(i % 3 if i % 7 else None, (i * 31) % 50) for i in range(200)], "g int, v int")
    got = runtime.ranked(rows, ["v"], ["g"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r["rank"], r.v))
    for own in by.values():
        own.sort()
        assert [k for k, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
    assert sorted(r["rank"] for r in runtime.ranked(rows, ["v"]).collect()) == list(range(200))
    monkeypatch.setattr(runtime, "HOT_KEYS", 2)
    left = spark.createDataFrame([(i if i < 20 else 7, i) for i in range(100)] + [(None, 1)], "k int, x int")
    right = spark.createDataFrame([(i, i * i) for i in range(12)], "k int, y int")
    assert sorted(map(tuple, runtime.skew_join(left, right, ["k"], least=10).collect())) == sorted(map(tuple, left.join(right, "k").collect()))
