import __spark_entry__ as e
from test_whole_length import SF, by_duckdb, same_rows


def test_interval_has_the_reference_size(spark):
    rows = e.queries()["bootstrap_interval"](spark, SF).collect()
    assert {r.n for r in rows} == {100}
    same_rows(rows, by_duckdb(e.oracle_sql()["bootstrap_interval"]), ["lang"])


def test_token_bootstraps_have_the_reference_size(spark, monkeypatch):
    from glyphstream.operators import stability

    asked, redraw = [], stability.resampled_counts
    monkeypatch.setattr(stability, "resampled_counts", lambda *a: asked.append(a[2:4]) or redraw(*a))
    assert {r.n for r in e.queries()["bootstrap_js"](spark, SF).collect()} == {100}
    assert {r.n for r in e.queries()["bootstrap_top_tokens"](spark, SF).collect()} == {100}
    drawn = e.queries()["bootstrap_enrichment"](spark, SF).groupBy("replicate").count().collect()
    assert {r.replicate for r in drawn} == set(range(1, 101))
    assert asked == [(100, 200_000)] * 3
