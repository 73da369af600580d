"""Codons counted by position, and retrieval over postings that aren't stored."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphstream.functions import sequence as q, text as t
from glyphstream.operators import align, tokens
from glyphstream.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k", [1, 3])
def test_position_counts_equal_plain_ones(spark, k):
    draw = random.Random(k)
    seqs = [(draw.choice("ab"), "".join(draw.choice("ACGTN-é") for _ in range(n))) for n in (0, 1, 2, 3, 4, 9, 30, 31, 100)] + [("c", None), ("a", "ACG\nTACGT")]
    df = spark.createDataFrame(seqs, "g string, s string").repartition(3)
    want = Counter()
    for g, s in seqs:
        parts = [line[i : i + k] for line in (s or "").split("\n") for i in range(0, len(line) - k + 1, k)]
        want.update((g, i, x) for i, x in enumerate(parts))
    assert {(r.g, r["at"], r.token): r.n for r in tokens.position_counts(df, k, ["g"]).collect()} == want
    assert tokens.position_counts(df.where("s is null or s = ''"), k, ["g"]).count() == 0


def test_codons_are_counted_before_they_leave_their_task(spark):
    """Twice the same sequences give the same rows in the exchange, and consensus and signals are those of single codons."""
    df = spark.createDataFrame([("x", "ATGAAACCC")] * 500, "g string, s string").coalesce(1)
    counted = align.codons_at(df, ["g"], "s")
    assert sorted((r["at"], r.codon, r.n) for r in counted.collect()) == [(0, "ATG", 500), (1, "AAA", 500), (2, "CCC", 500)]
    assert align.consensus_of(counted, "g").first().consensus == "MKP"
    before = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in before  # no row a codon


def test_alignments_are_dealt_out(spark):
    pairs = spark.createDataFrame([(i, "MKTAAACCC", "TAAA") for i in range(8)], "k int, a string, b string").coalesce(1)
    assert align.aligned(pairs, "k", "a", "b").rdd.getNumPartitions() > 1


def test_questions_store_no_index(spark):
    plan = QUERIES["benchmark_answers"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "postings" not in plan


def test_terms_and_topics_equal_their_definition(spark):
    df = spark.createDataFrame([(1, None), (2, "Él niño ÇA va, K3 ǅ été ẞtraße İx the GC"), (3, "")], "id int, s string")
    got = {r.id: (r.terms, r.topics) for r in df.select("id", t.terms(F.col("s")).alias("terms"), t.topics(F.col("s")).alias("topics")).collect()}
    assert got[1] == (None, ["project"]) and got[3] == ([], ["project"])
    folded = df.where("id = 2").select(F.array_distinct(F.filter(F.split(t.folded(F.col("s")), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(t.STOP_WORDS)))).first()[0]
    assert sorted(got[2][0]) == sorted(folded) and got[2][1] == ["sequence_context"]


def test_encoding_drops_what_no_sequence_has(spark):
    text = "".join(map(chr, range(1, 0x180)))
    old = F.regexp_replace(F.translate("s", q.SOURCE, q.TARGET), "[^ACGTN-]", "")
    r = spark.createDataFrame([(text,)], "s string").select(q.encoded(F.col("s")).alias("a"), old.alias("b")).first()
    assert r.a == r.b
