import hashlib
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphstream.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda: 14 <= len(d) <= 19 and luhn(d),
        "phone": lambda: 10 <= len(d) <= 15,
    }[kind]()


def plain(text):
    order = list(PATTERNS)
    return sorted(((m.start(), order.index(k), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])))


TEXTS = [
    None, "", "no data here", "é🙂 a.b@x.org_c@y.co.uk 10.0.0.256 10.0.0.255.7 1.2.3.4",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4242424242424242 x378282246310005",
    "call +1 (017) 555-7713 or +49 30 1234567 +1", "+12345678901234567 +1-800-555-0199.5", "12 " * 4000 + " 1.1.1.1",
    "1" * 20000 + "@", "a@" + "b." * 5000 + "c", "1" + "-1" * 9000, "4111111111111111 " * 3 + "x@y.z " * 200,
    "IBAN DE89 3704 0044 0532 0130 00 ok, GB82WEST12345698765433", "ssn 123-45-6789", "123-45-6789",
]


def test_base_spans_match_plain_search(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    for i, t in enumerate(TEXTS):
        base = [(s.start, s["rank"], s.end, s.kind) for s in got[i].spans if s["rank"] < 4]
        assert base == plain(t), (i, base)
    kinds = lambda i: [(s.kind, s.start, s.end) for s in got[i].spans if s["rank"] > 3]
    assert kinds(12) == [("iban", 5, 32)] and kinds(13) == [("ssn", 4, 15)] and kinds(14) == []
    assert pii.find(df.limit(0)).count() == 0


def test_sql_gives_the_same_rows(spark, tmp_path):
    more = ["to GB82 WEST 1234 5698 7654 32, ABCDEF", "éDE89370400440532013000é", "_DE89370400440532013000", "DE89370400440532013001", "SSN: 123-45-6789, 1.2.3.4 123-45-67890"]
    df = spark.createDataFrame(list(enumerate(TEXTS + more)), "doc_id long, text string").coalesce(1)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(queries.ORACLE_SQL["op7_pii_spans"]).fetchall())
    assert sorted(map(tuple, queries.op7_pii_spans(spark, str(tmp_path)).collect())) == want
    found = {r[0] - len(TEXTS): r[-1] for r in want if r[0] >= len(TEXTS)}
    assert found == {0: "iban:3:30", 1: "iban:1:23", 2: "", 3: "", 4: "ssn:5:16,ip:18:25"}


def test_random_texts_match_plain_search(spark):
    draw = random.Random(7)
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 4000))) for letters in ("ab@.-é ", "a@.b_%+", "01.", "12 -.", "+1 (0)-.2", "1@.a+ -漢") for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df).collect():
        assert [(s.start, s["rank"], s.end, s.kind) for s in r.spans if s["rank"] < 4] == plain(texts[r.doc_id]), r.doc_id


LONG = 1_000_000


@pytest.mark.parametrize("text, n, last", [
    ("a" * LONG + " x@y.co", 1, "x@y.co"), ("a" * LONG + "@b.co", 1, None), ("é" + "9" * LONG + " 1.2.3.4", 1, "1.2.3.4"), ("x@y.com " * (LONG // 8), LONG // 8, "x@y.com"),
    ("+1 " * (LONG // 3), 0, None), ("+12345678901 " * (LONG // 13), LONG // 13, "+12345678901"), ("a@" * (LONG // 2), 0, None), ("1." * (LONG // 2), LONG // 8, "1.1.1.1"), ("x@" + "a" * LONG, 0, None),
])
def test_very_long_texts_take_linear_time(spark, text, n, last):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (row,) = pii.find(df).select(F.size("spans").alias("n"), F.try_element_at("spans", F.lit(-1)).alias("last")).collect()
    assert row.n == n
    if last:
        assert text[row.last.start : row.last.end] == last
    (clean,) = pii.redact(df).select(F.sha2("text", 256).alias("sha")).collect()
    assert (clean.sha == hashlib.sha256(text.encode()).hexdigest()) == (n == 0)
    assert time.time() - began < 60


def test_redaction_of_a_long_text_joins_its_pieces(spark):
    text = "".join(f"é{i} a{i}@b.co " for i in range(3000))
    (row,) = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.text == re.sub(r"a[0-9]+@b\.co", "[EMAIL]", text)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "to a@b.co, é 1.2.3.4!"), (2, None), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {1: "to [EMAIL], é [IP]!", 2: None, 3: "clean"}


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_pii_spans(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in plain(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
