import random
import re

import numpy as np

from glyphstream.llm import line_dedup
from glyphstream.llm.hashing import word_hashes

S = line_dedup.Settings(line=4, window=6, least=12)


def plain(docs, least, short=1):
    """Per document, the words of runs, and of physical lines, found in an earlier document or earlier in its own text."""
    seen, lines_seen, gone = set(), set(), {}
    for doc, text in sorted(docs):
        words = (text or "").split()
        covered = set()
        for i in range(len(words) - least + 1):
            gram = tuple(words[i : i + least])
            if gram in seen:
                covered |= set(range(i, i + least))
            seen.add(gram)
        at = 0
        for line in (text or "").split("\n"):
            own = tuple(line.split())
            if len(own) >= short:
                if own in lines_seen:
                    covered |= set(range(at, at + len(own)))
                lines_seen.add(own)
            at += len(own)
        gone[doc] = covered
    return gone


def removed_words(text, runs):
    spans = [m.span() for m in re.finditer("[^\x20\x09-\x0d]+", text or "")]
    return {i for i, (a, b) in enumerate(spans) for r in runs if r.start <= a and b <= r.end}


def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(900)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [some(rng.randint(12, 40)) for _ in range(5)]
    docs = []
    for i in range(60):
        words = some(rng.randint(0, 80))
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = p
        docs.append((i, "".join(w + rng.choice([" ", "  ", "\n"]) for w in words)))
    docs += [(60, docs[5][1]), (61, docs[5][1]), (62, "é x " * 40), (63, " ".join(passages[0] * 3)), (64, None), (65, "")]
    return docs


def test_removed_runs_match_plain_search(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, removed_runs int").repartition(5)
    want, texts = plain(docs, S.least), dict(docs)
    rows = line_dedup.dedup_lines(df, S).collect()
    assert len(rows) == len(docs)
    for r in rows:
        gone = removed_words(texts[r.doc_id], r.removed_runs)
        assert gone == want[r.doc_id], r.doc_id
        words = (texts[r.doc_id] or "").split()
        assert (r.text or "").split() == [w for i, w in enumerate(words) if i not in gone]
        if not gone:
            assert r.text == texts[r.doc_id]


def test_physical_lines_of_any_length(spark):
    docs = [(1, "One short line\nOf.\nsome text of its own"), (2, "another text\n one  short line\nOne short\tline \nOf."), (3, "Of.\nOf.\n\nlast words"), (4, "a text with One short line in it")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: docs[0][1], 2: "another text\n one  short line\n", 3: "last words", 4: docs[3][1]} | {2: got[2], 3: got[3]}
    assert got[2].split() == "another text one short line".split() and got[3].split() == ["last", "words"]
    assert line_dedup.dedup_lines(df, line_dedup.Settings(short=4)).where("size(removed_runs) > 0").count() == 0


def test_texts_that_share_an_id_are_cut_apart(spark):
    x = [f"x{i}" for i in range(60)]
    docs = [(1, " ".join(x)), (2, "a b c " + " ".join(x)), (2, " ".join(f"y{i}" for i in range(70)))]
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted([docs[0], (2, "a b c"), docs[2]])


def test_repeated_ids_nulls_and_no_rows(spark):
    text = " ".join(f"t{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    rows = line_dedup.dedup_lines(df, S).collect()
    assert sorted((r.doc_id or -1, r.text) for r in rows) == [(-1, text), (1, text), (1, text), (2, "")]
    assert line_dedup.dedup_lines(df.limit(0), S).count() == 0


def test_every_long_enough_run_shares_a_fingerprint():
    rng = np.random.default_rng(0)
    words = [f"w{i}".encode() for i in rng.integers(0, 500, 400)]
    shared = words[100 : 100 + S.line + S.window - 1]
    text, _, fp = line_dedup.winnow(*word_hashes([b" ".join(words), b" ".join([b"x"] * 9 + shared + [b"y"] * 9)]), S)
    assert set(fp[text == 0].tolist()) & set(fp[text == 1].tolist())
    x = rng.integers(0, 50, 77).astype(np.uint64)
    assert line_dedup._least_of_windows(x, 5)[:73].tolist() == [min(x[i : i + 5]) for i in range(73)]
