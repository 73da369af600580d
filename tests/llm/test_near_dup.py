import random
from itertools import combinations

import numpy as np

from glyphstream.llm import hashing, near_dup
from glyphstream.llm.components import components

S = near_dup.Settings(words=3, threshold=85, bands=25, rows=5)


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def plain(docs, k, threshold):
    sets = {i: shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= threshold * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "é", "A", "a"]
    docs = [None, "", " \n", "one", "One", "two words", "a b c", "A B C"]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 160))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            docs.append(" ".join(words))
    passage = [rng.choice(vocab) for _ in range(60)]
    docs += [" ".join(passage + [rng.choice(vocab) for _ in range(rng.randint(8, 40))]) for _ in range(30)]
    docs += [docs[20]] * 15
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_components_match_all_pairs(spark):
    docs = corpus(4)
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_shingles int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, S).collect()}
    assert got == plain(docs, 3, 85)


def test_five_words_at_eighty(spark):
    docs = corpus(9)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain(docs, 5, 80)
    kept = {r.doc_id for r in near_dup.drop_near_duplicates(df, near_dup.Settings()).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, "x y z w"), (1, "x y z w"), (None, "x y z w"), (3, "x y z w")], "doc_id long, text string")
    rows = near_dup.near_duplicates(df, S).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (1, 1, True), (1, 1, True), (3, 1, False)]
    assert near_dup.near_duplicates(df.limit(0), S).count() == 0


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_hashes_tell_words_apart():
    words, counts = hashing.word_hashes([b"a b a", b"", b" b\x0ba ", b"ab"])
    assert counts.tolist() == [3, 0, 2, 1] and words[0] == words[2] == words[4] and words[1] == words[3]
    assert len(np.unique(words)) == 3


def test_chunks_of_open_buckets(spark, monkeypatch):
    """Buckets whose members stay apart after the pivots, in chunks of few members and bytes; frequent keys by broadcast."""
    from glyphstream import runtime

    monkeypatch.setattr(near_dup, "MEMBERS", 4)
    monkeypatch.setattr(near_dup, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(near_dup, "PIVOTS", 1)
    monkeypatch.setattr(runtime, "HOT_KEYS", 3)
    monkeypatch.setattr(runtime.skew_join, "__defaults__", (None, 5))
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for group in range(10):
        own = base[:100] + [f"g{group}_{i}" for i in range(20)]  # groups share 100 words, too few to be linked
        for _ in range(4):
            words = list(own)
            words[rng.randrange(100, 120)] = f"x{rng.random()}"
            docs.append(" ".join(words))
    rng.shuffle(docs)
    docs = list(enumerate(docs)) + [(100 + i, " ".join(base[:40])) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), S).collect()}
    assert got == plain(docs, 3, 85)


def test_a_column_named_like_ours(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8), (None, None, 9)], "doc_id long, text string, __gone int")
    assert sorted(r["__gone"] for r in near_dup.drop_near_duplicates(df, near_dup.Settings()).collect()) == [7, 9]
