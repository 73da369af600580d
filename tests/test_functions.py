import pytest
from pyspark.sql import functions as F

from glyphstream.functions import codon, sequence as q, text as t


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "s string").select(*columns).first()


def test_composition(spark):
    s = F.col("s")
    assert one(spark, "ACGT", q.gc_content(s))[0] == 0.5
    assert one(spark, "ACGTNN", q.ambiguous_fraction(s))[0] == pytest.approx(2 / 6)
    assert one(spark, "", q.ambiguous_fraction(s), q.gc_content(s)) == (1.0, None)
    assert one(spark, "ACGTNN", F.size(q.overlapping(s, 2)))[0] == 5
    assert one(spark, "ac g-u\n", q.normalized(s), q.cleaned(s), q.gapless(s)) == ("AC G-T\n", "ACG-T", "ACGT")
    assert one(spark, "AX-N", q.invalid_count(s))[0] == 2


def test_tokens(spark):
    s = F.col("s")
    assert one(spark, "AATGAAAC", q.stepped(s, 3, 1))[0] == ["ATG", "AAA"]
    assert one(spark, "ATGA", q.overlapping(s, 3), q.stepped(s, 3), q.stepped(s, 0)) == (["ATG", "TGA"], ["ATG"], [])
    at = spark.createDataFrame([(a, b) for a in range(8) for b in range(a + 1, 9)], "a int, b int")
    for frame in (0, 1, 2):
        for r in at.select("a", "b", q.crosses_boundary(F.col("a"), F.col("b"), frame).alias("x")).collect():
            assert r.x == any((p - frame) % 3 == 0 for p in range(r.a + 1, r.b))


def test_codons(spark):
    s = F.col("s")
    assert one(spark, "ATGTAACTNNNN-AA", codon.translated(s))[0] == "M*LXX"
    assert one(spark, "ATGTAAATG", codon.internal_stops(codon.translated(s)))[0] == 1
    assert sorted(c for c, a in codon.ambiguous_code().items() if "N" in c and a != "X") == ["ACN", "CCN", "CGN", "CTN", "GCN", "GGN", "GTN", "TCN"]
    status = lambda x, **k: codon.rescued(spark.createDataFrame([(x,)], "s string"), "s", codon.Rescue(**k)).first()
    assert status("ATGAAA").status == "strict_pass"
    assert status("ATGTAAATG", left=0, right=0).status == "unrescued"
    assert status("").status == "empty" and status("NNN").status == "ambiguous"
    got = status("A-ATGAAACCC")
    assert (got.status, got.method, got.trim_left, got.trim_right) == ("rescued", "gap_normalized_trim", 0, 1)


def test_usage_sums_to_one(spark):
    rows = spark.createDataFrame([(1, "ATGATGTAANNN")], "id int, s string")
    got = {r.codon: r for r in codon.usage(codon.codon_counts(rows, ["id"], "s"), ["id"]).collect()}
    assert got["ATG"].n == 2 and got["ATG"].rscu == 1.0 and got["TAA"].rscu is None
    assert sum(r.frequency for r in got.values()) == pytest.approx(1)


def test_labels_and_texts(spark):
    s = F.col("s")
    assert one(spark, " a/h3n2 x", t.subtype(s))[0] == "H3N2" and one(spark, " ", t.subtype(s))[0] == "UNKNOWN"
    assert one(spark, "seg4", t.segment(s))[0] == "HA" and one(spark, "the ha gene", t.segment_in(s))[0] == "HA"
    assert one(spark, "no gene", t.segment_in(s), t.subtype_in(s)) == (None, None)
    assert one(spark, " Europe / / France ", t.location_parts(s))[0] == ["Europe", "France"]
    assert [one(spark, x, t.major_clade(s))[0] for x in ("6B.1A.5", "1.2.3", "unassigned", "nan")] == ["6B.1A", "1.2", "unassigned", None]
    assert one(spark, "2019-02", t.leading_year(s))[0] == 2019 and one(spark, "n/a", t.leading_year(s))[0] is None
    assert one(spark, "a ```code``` b " + "ACGT" * 30, t.guide_text(s))[0] == "a b [sequence]"
    assert one(spark, "Codon table", t.topics(s))[0] == ["cds"] and one(spark, "x", t.topics(s))[0] == ["project"]
    assert one(spark, "What is the GC of it? Qué és una Sección Straße", t.terms(s))[0] == ["gc", "of", "seccion", "stra"]
    assert one(spark, "e\u0301 \u00c9\u1ec7", t.folded(s))[0] == "e ee"
    assert one(spark, " ", t.segment(s))[0] == one(spark, None, t.segment(s))[0] == "UNKNOWN"
    assert one(spark, "prehemagglutinins", t.segment_in(s))[0] == "HA" and one(spark, "a Neuraminidase2", t.segment_in(s))[0] == "NA"
    has = lambda f: [one(spark, x, f(s))[0] for x in ("", "nan", "missing", "none", "unknown", " ", "x", None)]
    assert has(t.has_clade) == [False, False, False, True, True, True, True, False]
    assert has(t.has_country) == [False, False, True, False, False, False, True, False]
    assert len(one(spark, "# A\n" + "x" * 90 + "\n# B\nshort", t.sections(s))[0]) == 1
    assert one(spark, "y" * 90 + ". z", t.first_sentence(s))[0] == "y" * 90 + "."
    assert one(spark, "Design a virus", t.mentions(s, ["design"]))[0] is True and one(spark, "¿Predécir?", t.mentions(s))[0] is True
    assert one(spark, "z " * 300, t.first_sentence(s))[0] == ("z " * 180).strip()


def test_identity_and_bins(spark):
    s = F.col("s")
    got = one(spark, "x", q.stable_id(s, F.lit(None)), q.salted_id(s, "k", "lm", 18), q.year_bin(F.lit(2010), [2008, 2014]), q.year_bin(F.lit(None).cast("int"), [2008]), q.finite(F.lit(float("nan"))))
    assert got[0].startswith("gs_") and len(got[1]) == 21 and got[2:] == ("<=2014", "unknown", None)
    assert one(spark, "x", q.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>")))[0] == 1.0
