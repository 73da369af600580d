import random

from pyspark.sql import functions as F

from glyphstream import runtime
from glyphstream.functions import text as t
from glyphstream.operators import retrieval

WORDS = ["gc", "token", "entropy", "Público", "licénse", "struct", "the", "x", "CODON", "latent", "été", "İx", "naïve", "Straße", "KK9"]


def chunks(spark, n, seed=1):
    draw = random.Random(seed)
    some = lambda k: " ".join(draw.choice(WORDS) + draw.choice([" ", ",", "-", "·"]) for _ in range(k))
    rows = [(i, some(2), some(1), [draw.choice(["tokenization", "gc-tag", "cds"])], some(12)) for i in range(n)]
    rows += [(n, None, None, None, None), (n + 1, "", "", [], "")]
    return spark.createDataFrame(rows, "id long, title string, section string, tags array<string>, text string"), rows


def folded_terms(spark, texts):
    """By folding whole texts first: the plain way."""
    whole = F.split(t.folded(F.col("x")), "[^a-z0-9]+")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", whole.alias("w")).collect()
    return {r.i: {w for w in r.w or [] if len(w) > 1 and w not in t.STOP_WORDS} for r in rows}


def plain(spark, rows, questions, top=4):
    fields = [x or "" for r in rows for x in (f"{r[1] or ''} {r[2] or ''}", " ".join(r[3] or []), r[4])]
    found = folded_terms(spark, fields + [q or "" for _, q in questions])
    out = {}
    for k, (q, text) in enumerate(questions):
        if text is None or len(text.strip()) < 4:
            continue
        wanted = set(found[len(fields) + k])
        wanted |= {a for w in list(wanted) for a in t.ALIASES.get(w, [])}
        scores = []
        for j, r in enumerate(rows):
            title, tags, body = (found[3 * j + i] for i in range(3))
            scores.append((-(len(wanted & (title | tags | body)) + 3 * len(wanted & title) + 4 * len(wanted & tags)), r[0]))
        best = sorted(s for s in scores if s[0] < 0)[:top] or [(0, i) for i in sorted(r[0] for r in rows)[:top]]
        out[q] = [(i + 1, c, -s) for i, (s, c) in enumerate(best)]
    return out


def test_all_questions_from_one_index(spark, monkeypatch):
    df, rows = chunks(spark, 60)
    questions = [(1, "What of the gc token?"), (2, "zzz unmet"), (3, " gc "), (4, None), (5, "LICENSE público K9"), (6, "ete naive strasse straße"), (7, "the de la"), (8, "structure rscu")]
    asked = spark.createDataFrame(questions, "question int, text string")
    expected = plain(spark, rows, questions)
    join = runtime.many_join
    for part in (50_000, 5):  # and with every frequent term dealt out
        monkeypatch.setattr(retrieval, "many_join", lambda a, b, k, part=part: join(a, b, k, part))
        got = {}
        for r in retrieval.answers(retrieval.index(df), df, asked).orderBy("question", "rank").collect():
            got.setdefault(r.question, []).append((r["rank"], r.id, r.score))
        assert got == expected
    one = retrieval.answer(df, questions[0][1]).select("id", "score").collect()
    assert [(r.id, r.score) for r in one] == [x[1:] for x in expected[1]]


def test_no_chunks_and_no_questions(spark):
    df, _ = chunks(spark, 3)
    asked = spark.createDataFrame([(1, "gc token")], "question int, text string")
    assert retrieval.answers(retrieval.index(df.limit(0)), df.limit(0), asked).count() == 0
    assert retrieval.answers(retrieval.index(df), df, asked.limit(0)).count() == 0
    assert retrieval.answer(df.limit(0), "gc token").count() == 0


def test_replies(spark):
    df = spark.createDataFrame([(1, "Panel", "docs", ["dataset"], "A table of records. " * 6), (2, "GC", "docs", ["sequence_context", "dataset"], "gc share")], "id long, title string, section string, tags array<string>, text string")
    asked = spark.createDataFrame([(1, "gc of a panel"), (2, "does it predict gc?")], "question int, text string")
    got = {r.question: r for r in retrieval.replies(df, asked, retrieval.answers(retrieval.index(df), df, asked)).collect()}
    assert got[1].in_scope and got[1].citations == "[1] GC (docs); [2] Panel (docs)" and got[1].topics == "sequence_context,dataset" and got[1].view == "atlas"
    assert got[1].opening == "gc share" and not got[2].in_scope and got[2].opening is None
