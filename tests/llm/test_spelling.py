import random
import re
import zlib
from collections import Counter

from glyphstream.llm import spelling

LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_words(docs):
    found = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = 1 if doc is None else zlib.crc32(f"{doc}:{run}".encode())
            found[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_forms(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def forms(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_damaged_vocabulary(spark):
    draw = random.Random(2)
    docs = [(i, " ".join(draw.choice(["Thtion", "Éclairé", "naïveté", "WINDOWS", "ABC", "water", "Straße"]) for _ in range(60)) + "-q" * 3) for i in range(120)]
    docs += [(None, "Windows windows"), (5, None), (6, ""), (7, "x" * 300_000 + "é1"), (7, "x" * 300_000), (8, "X" * 300_000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, word int")
    assert {r.word: r.n for r in spelling.vocabulary(df).collect()} == plain_words(docs)
    assert spelling.vocabulary(df.limit(0)).count() == 0


def test_every_link_is_found(spark):
    draw = random.Random(3)
    words = {}
    for letters, most in (("ab", 9), ("abcé", 8), ("nhtr", 12)):  # repeated bigrams, few letters: the filter's hard case
        for _ in range(350):
            words["".join(draw.choice(letters) for _ in range(draw.randint(5, most)))] = draw.randint(3, 200)
    long = "".join(draw.choice("abcdefgh") for _ in range(20_000))
    words |= {long: 10, long[:9_000] + long[9_001:]: 3, long[:9_000] + "z" + long[9_001:]: 4, "a" * 3_000: 7, "a" * 3_001: 3}
    df = spark.createDataFrame([(n, w) for w, n in words.items()], "n long, word string")
    assert forms(spelling.variants(df)) == plain_forms(words)


def test_a_large_bucket_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BUCKET", 7)
    words = {f"zq{a}{b}{c}": 3 + 2 * (a == b) + 9 * (b == c) for a in "abcde" for b in "abcde" for c in "abcde"}
    df = spark.createDataFrame([(n, w) for w, n in words.items()], "n long, word string")
    assert forms(spelling.variants(df)) == plain_forms(words)


def test_ties_chains_and_odd_words(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaaac": 6, "aaabc": 12, "aabbc": 24, "lonely": 3, "abcd": 5, "xyz": 3, "xy": 9}
    df = spark.createDataFrame([(n, w) for w, n in words.items()] + [(4, None)], "n long, word string")
    got = forms(spelling.variants(df))
    expected = plain_forms({w: n for w, n in words.items() if len(w) > 3}) | {w: (None, w, n, 0, None) for w, n in words.items() if len(w) < 4}
    assert got == expected and got["aaaaa"][:2] == ("aaaab", "aaaab") and got["aaaac"][1] == "aabbc"
    assert spelling.variants(df.limit(0)).count() == 0
