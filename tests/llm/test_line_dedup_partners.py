import random

from test_line_dedup import S, corpus, plain, removed_words

from glyphstream.llm import line_dedup


def held(spark, docs, settings=S):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = line_dedup.dedup_lines(df, settings).collect()
    want, texts = plain(docs, settings.least), dict(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert removed_words(texts[r.doc_id], r.removed_runs) == want[r.doc_id], r.doc_id
    return want


def test_a_partner_with_a_short_part_hides_no_other(spark):
    """A (and more documents) hold less than 50 words of a passage that B and C repeat in full."""
    rng = random.Random(2)
    n = iter(range(10**6))
    fresh = lambda k: [f"w{next(n)}" for _ in range(k)]
    docs = []
    for size, part in [(60, 45), (70, 45), (80, 49), (55, 20), (50, 49)] * 6:
        passage = fresh(size)
        at = rng.randint(0, size - part)
        parts = [passage[at : at + part], *([passage[-part:], passage[:part]] if rng.random() < 0.5 else [])]
        docs += [[*fresh(30), *p, *fresh(30)] for p in parts] + [[*fresh(20), *passage, *fresh(9)] for _ in range(2)]
        docs.append([*fresh(5), *passage[at : at + part], *fresh(8), *passage, *fresh(7), *passage])  # the part stands before in the same text
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    want = held(spark, docs, line_dedup.Settings())
    assert sum(map(len, want.values())) > 60 * 60


def test_removed_runs_equal_plain_search(spark):
    held(spark, [(i, t) for i, t in corpus()])


def test_a_run_that_goes_on_elsewhere_goes_whole(spark):
    x = [f"x{i}" for i in range(80)]
    docs = [(0, " ".join(x[:60])), (1, "a b " + " ".join(x[20:80])), (2, "c " + " ".join(x) + " d")]
    want = held(spark, docs, line_dedup.Settings())
    assert len(want[2]) == 80
