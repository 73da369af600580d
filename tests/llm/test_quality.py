import re
from collections import Counter

from glyphstream.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measures_match_plain_counts(spark):
    texts = [
        None, "", "  \t\n ", "one", "a b c d e f g h", "a b c d e f g h " * 3, "x " * 300, "é|漢 <b>\n\nq\nq\nq \x0b z\x85z　y",
        "w0 " + " ".join(f"w{i % 37}" for i in range(5000)), " ".join(f"w{i}" for i in range(60)) + " " + " ".join(f"w{i}" for i in range(20, 40)),
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality.ledger(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(t or ""), i
    assert got[0].failures == got[1].failures == quality.BITS["too_few_words"]
    assert quality.ledger(df.limit(0)).count() == 0


def test_ablation_counts(spark):
    df = spark.createDataFrame([(1, "short"), (2, "# " * 40), (3, " ".join(f"word{i}" for i in range(50)))], "doc_id long, text string")
    rows = {(r.policy, r.rule): r for r in quality.ablation(quality.ledger(df)).collect()}
    assert rows["v1", "too_few_words"].n_kept == 1
    assert rows["v1", "too_few_words"].n_kept_without == 2 and rows["v1", "too_few_words"].n_failed_alone == 1
    assert rows["base", "repeated_words"].n_failed_alone == 1
