import random

from glyphstream.operators import align
from glyphstream.plans import structures as st

SF = "/root/testdata/sf0.001"


def best_score(a, b, match=2, mismatch=-1, open_=-10, extend=-0.5):
    """The score of the best local alignment, cell by cell."""
    none, best = float("-inf"), 0.0
    m, x, y = {}, {}, {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                m[i, j], x[i, j], y[i, j] = 0.0, none, none
                continue
            x[i, j] = max(m[i - 1, j] + open_, x[i - 1, j] + extend)
            y[i, j] = max(m[i, j - 1] + open_, y[i, j - 1] + extend)
            m[i, j] = max(0.0, m[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), x[i, j], y[i, j])
            best = max(best, m[i, j])
    return best


def score_of(a, b, pairs):
    total, last = 0.0, None
    for i, j in pairs:
        total += 2 if a[i] == b[j] else -1
        if last and (gap := (i - last[0] - 1) + (j - last[1] - 1)):
            total += -10 - 0.5 * (gap - 1)
        last = i, j
    return total


def test_quality_and_mapping_of_a_few_entries(spark):
    entries = spark.createDataFrame(
        [("1ABC", 1, "A, B", "H1N1", "HA", "TAAA"), ("1ABC", 2, "C", "H1N1", "NA", "TAAA"), ("2DEF", 1, None, "H1N1", "HA", ""), ("3GHI", 1, "A", "H1N1", "HA", None), ("4JKL", 1, "A", "H1N1", "HA", "WWWW")],
        "structure string, entity int, chains string, subtype string, protein string, sequence string",
    )
    cons = spark.createDataFrame([("H1N1", "HA", "MKTAAACCC")], "subtype string, protein string, consensus string")
    signals = spark.createDataFrame([("H1N1", "HA", "HA-H1N1", 3, 0.5), ("H1N1", "HA", "other", 4, 0.9), ("H1N1", "NA", "NA-H1N1", 3, 0.1)], "subtype string, protein string, group string, at int, gc double")
    qc, mapping = align.structure_tables(entries, cons, signals)
    got = {(r.structure, r.entity): r for r in qc.collect()}
    a = got["1ABC", 1]
    assert (a.n_mapped, a.identity, a.coverage_structure, a.local_start, a.local_end, a.status) == (4, 1.0, 1.0, 3, 6, "alignment_qc_available") and round(a.coverage_local, 6) == 0.444444
    for key in (("1ABC", 2), ("2DEF", 1), ("3GHI", 1), ("4JKL", 1)):
        assert got[key].status == "unmapped" and got[key].n_mapped == 0 and got[key].identity is None and got[key].local_start is None
    assert len(got) == 5 and got["1ABC", 2].consensus_length == 0
    assert sorted((r.at, r.structure_at, r.gc) for r in mapping.collect()) == [(3, 1, 0.5), (4, 2, None), (5, 3, None), (6, 4, None)]
    assert {r.group for r in mapping.collect()} == {"HA-H1N1"}


def test_alignments_are_the_best_there_are():
    draw = random.Random(8)
    for _ in range(60):
        a = "".join(draw.choice("ACDE") for _ in range(draw.randint(1, 40)))
        b = a[draw.randint(0, 5) :][: draw.randint(1, 30)] if draw.random() < 0.5 else "".join(draw.choice("ACDE") for _ in range(draw.randint(1, 40)))
        score, pairs = align.local_alignment(a, b)
        assert score == best_score(a, b) == score_of(a, b, pairs)


def test_queries_over_the_tables(spark):
    qc = st.structure_quality(spark, SF).collect()
    n = spark.read.parquet(f"{SF}/benchmark.parquet").count()
    assert len(qc) == n and {r.status for r in qc} == {"alignment_qc_available"}
    positions = {}
    for r in st.structure_mapping(spark, SF).collect():
        assert r.group == f"{r.protein}-{r.subtype}" and r.n is not None and 0 <= r.gc <= 1
        positions.setdefault((r.structure, r.entity), []).append(r["at"])
    for r in qc:
        assert (len(positions[r.structure, r.entity]), min(positions[r.structure, r.entity]), max(positions[r.structure, r.entity])) == (r.n_mapped, r.local_start, r.local_end)
