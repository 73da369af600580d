from collections import Counter

import numpy as np

from glyphstream.functions import codon
from glyphstream.operators import sparse
from glyphstream.plans import representations as r
from glyphstream.plans.queries import sequences

SF = "/root/testdata/sf0.001"


def plain_matrix(seqs, k, tfidf):
    at = {n: i for i, n in enumerate(sparse.all_kmers(k))}
    x = np.zeros((len(seqs), 4**k))
    for i, s in enumerate(seqs):
        for token, n in Counter(s[j : j + k] for j in range(len(s) - k + 1)).items():
            if token in at:
                x[i, at[token]] = n
    if not tfidf:
        return x / np.maximum(x.sum(axis=1, keepdims=True), 1)
    x = x * (np.log((1 + len(seqs)) / (1 + (x > 0).sum(axis=0))) + 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def test_maps_equal_a_dense_projection(spark, monkeypatch):
    rows = sorted(map(tuple, sequences(spark, SF).select("doc_id", "s").collect()))
    ids, seqs = [i for i, _ in rows], [s for _, s in rows]
    for name, k, tfidf in (("kmer4_tfidf", 4, True), ("kmer5_freq", 5, False)):
        x = plain_matrix(seqs, k, tfidf)
        c = x - x.mean(axis=0)
        _, s, vt = np.linalg.svd(c, full_matrices=False)
        v = vt[:3].T * np.sign(vt[:3].T[np.abs(vt[:3].T).argmax(axis=0), range(3)])
        points, found = r.mapped(spark, SF, name)
        got = {p.doc_id: p.projected for p in points.collect()}
        assert np.allclose(found.ratios, (s**2 / (s**2).sum())[:3], atol=1e-6) and found.nnz == (x != 0).sum()
        assert np.allclose(np.array([got[i] for i in ids]), c @ v, atol=1e-4)


def test_queries_of_maps_and_report(spark):
    points = r.representation_maps(spark, SF).collect()
    assert Counter(p.representation for p in points) == {name: 200 for name in r.MAPS} and all(p.id.startswith("pt_") for p in points)
    axes = {a.representation: a for a in r.representation_axes(spark, SF).collect()}
    assert axes["rscu"].n_features == 61 and axes["kmer5_freq"].n_features == 1024 and all(a.explained1 >= a.explained2 >= a.explained3 for a in axes.values())
    report = {(x.representation, x["by"]): x for x in r.representation_report(spark, SF).collect()}
    assert report.keys() == {(name, by) for name in r.REPRESENTATIONS for by in r.LABELS}
    assert all(-1 <= x.silhouette <= 1 and x.n_judged == 200 for x in report.values())


def test_reliable_counts_and_refined_sequences(spark):
    seqs = {1: "ATGAAACCC", 2: "ATGTAAATG", 3: "ATGAA", 4: "ATGNAA", 5: None, 6: "", 7: "ATG-AAA", 8: "CATGAAATAA"}
    df = spark.createDataFrame(list(seqs.items()), "id long, s string")
    got = {x.id: (x.reliable, x.counts) for x in codon.reliable_counts(df, ["id"]).collect()}
    assert got[1] == (True, {"ATG": 1, "AAA": 1, "CCC": 1}) and all(got[i] == (False, {}) for i in (2, 3, 4, 5, 6))
    mended = {x.id: (x.status, x.sequence) for x in codon.refined(df, "id").collect()}
    assert mended[1] == ("strict_pass", "ATGAAACCC") and mended[7] == ("strict_pass", "ATGAAA") and mended[8] == ("rescued", "ATGAAATAA") and 6 not in mended
