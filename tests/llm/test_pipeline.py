import corpus_pipeline as p
from glyphstream.llm import line_dedup, pii, toxicity
from test_line_dedup import plain as plain_lines
from test_near_dup import plain as plain_groups
from test_packing import hold

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    steps = [docs]
    for _, stage in p.STAGES:
        steps.append(stage(spark, steps[-1], SF).cache())
    clean, lined, apart, safe, packed = steps[1:]
    assert all(d.columns == docs.columns for d in steps[1:-1])

    model = toxicity.learn_from(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    rows = {r.doc_id: r for r in clean.collect()}
    assert set(rows) == {i for i, s in scores.items() if s < p.TOXIC} and all(rows[i] == before[i] for i in rows)

    gone = plain_lines([(i, r.text) for i, r in rows.items()], 50)
    lined_rows = {r.doc_id: r for r in lined.collect()}
    words = {i: (r.text or "").split() for i, r in rows.items()}
    left = {i: [w for j, w in enumerate(words[i]) if j not in gone[i]] for i in rows}
    runs = {r.doc_id: r.removed_runs for r in line_dedup.dedup_lines(clean).collect()}
    held = {i: len({c for r in own if r.source != i for c in range(r.start, r.end)}) for i, own in runs.items()}
    copies = {i for i in rows if gone[i] and (not left[i] or held[i] >= p.LOST and len(rows[i].text) - held[i] < p.STAYS * len(rows[i].text))}
    assert set(lined_rows) == set(rows) - copies and copies
    for i, r in lined_rows.items():
        assert (r.text or "").split() == left[i] and (gone[i] or r == rows[i])

    groups = plain_groups([(i, r.text) for i, r in lined_rows.items()], 5, 80)
    apart_rows = {r.doc_id: r for r in apart.collect()}
    assert set(apart_rows) == {i for i, (_, c) in groups.items() if c == i}
    assert all(apart_rows[i] == lined_rows[i] for i in apart_rows)

    safe_rows = {r.doc_id: r for r in safe.collect()}
    assert set(safe_rows) == set(apart_rows)
    found = {r.doc_id: r.spans for r in pii.find(apart).collect()}
    assert all((safe_rows[i].text == apart_rows[i].text) == (not found[i]) for i in safe_rows)
    assert all(r.n_chars == len(r.text) for r in safe_rows.values())

    hold(packed.collect(), [(i, r.text) for i, r in safe_rows.items()], p.PACK_SIZE)
    assert p.run(spark, SF).count() == packed.count()


def test_stages_on_odd_rows(spark):
    rows = [
        (1, None, None, None, None, 9.0), (None, "no id here", "en", "s", 10, 1.0), (2, "", "en", None, 0, None), (3, "word " * 40000, "en", "s", 200000, 1.0),
        (4, "same row", "de", "s", 8, 1.0), (4, "same row", "de", "s", 8, 1.0), (5, "to a@b.co now", None, "s", 13, 1.0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    for docs in (df, df.limit(0)):
        for name, stage in p.STAGES:
            out = stage(spark, docs, SF).cache()
            if name != "packing":
                assert out.columns == p.COLUMNS
                docs = out
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert not texts or (texts[1] is None and texts[2] == "" and texts[5] == "to [EMAIL] now" and len(texts[3].split()) < 100)
        assert {r.doc_id for r in out.collect()} == set(texts)
