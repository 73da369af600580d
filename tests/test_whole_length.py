import random

import duckdb
import pytest

import __spark_entry__ as e
from glyphstream.operators import align

SF = "/root/testdata/sf0.001"


def by_duckdb(sql):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    rel = con.sql(sql)
    return [dict(zip(rel.columns, r)) for r in rel.fetchall()]


def same_rows(got, want, keys):
    place = lambda r: [str(r[k]) for k in keys]
    got, want = sorted((r.asDict() for r in got), key=place), sorted(want, key=place)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == {k: pytest.approx(v, abs=2e-6) if isinstance(v, float) else v for k, v in w.items()}


@pytest.mark.parametrize("name, keys", [("residue_signals", ["lang", "at"]), ("consensus", ["lang"])])
def test_every_codon_counts(spark, name, keys):
    same_rows(e.queries()[name](spark, SF).collect(), by_duckdb(e.oracle_sql()[name]), keys)
    if name == "residue_signals":
        assert max(r["at"] for r in e.queries()[name](spark, SF).collect()) > 1000


def cells(a, b, match=2, mismatch=-1, open_=-10, extend=-0.5):
    """The score of the best local alignment, cell by cell."""
    none, best, top = float("-inf"), [0.0] * (len(b) + 1), 0.0
    down = [none] * (len(b) + 1)
    for x in a:
        row, right = [0.0], none
        for j, y in enumerate(b):
            down[j + 1] = max(best[j + 1] + open_, down[j + 1] + extend)
            right = max(row[j] + open_, right + extend)
            row.append(max(0, best[j] + (match if x == y else mismatch), down[j + 1], right))
        best, top = row, max(top, *row)
    return top


def worth(a, b, pairs, match=2, mismatch=-1, open_=-10, extend=-0.5):
    total = sum(match if a[i] == b[j] else mismatch for i, j in pairs)
    for (i, j), (k, m) in zip(pairs, pairs[1:]):
        assert k > i and m > j
        total += sum(open_ + extend * (gap - 2) for gap in (k - i, m - j) if gap > 1)
    return total


@pytest.mark.parametrize("held", [1 << 25, 50])
def test_alignment_in_blocks(monkeypatch, held):
    monkeypatch.setattr(align, "CELLS", held)
    if held < 100:
        monkeypatch.setattr(align, "CUTS", 3)
    rng = random.Random(4)
    for _ in range(30):
        a = "".join(rng.choice("ACD") for _ in range(rng.randint(0, 70)))
        b = a[: len(a) // 2] + "W" * rng.randint(0, 4) + a[len(a) // 2 + rng.randint(0, 3) :]
        score, pairs = align.local_alignment(a, b)
        assert score == cells(a, b) == worth(a, b, pairs)


def test_alignment_map_reaches_the_ends(spark):
    cons = {r.lang: r.consensus for r in e.queries()["consensus"](spark, SF).collect()}
    rows = e.queries()["alignment_map"](spark, SF).where("lang = 'en'").collect()
    assert len(rows) == len(cons["en"]) > 100
    assert {r.structure_at for r in rows} == {r["at"] for r in rows} == set(range(len(cons["en"])))
