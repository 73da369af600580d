import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from glyphstream.llm import trie


def plain(rows, rebuild=True):
    """The nodes by their members alone: (conv_id, depth) to the other columns."""
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in said.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def below(node):
        yield node
        for k in kids[node]:
            yield from below(k)

    out = {}
    for node, ids in members.items():
        under = list(below(node))
        out[min(ids), len(node)] = (
            min(members[node[:-1]]) if node else None, len(ids), len(kids[node]), sum(not kids[u] for u in under),
            sum((len(members[u]) - 1) * len(u[-1][1]) for u in under if u), hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
    return out


def got(df):
    rows = df.collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def frame(spark, rows):
    return spark.createDataFrame([(0.5, *r) for r in rows], "depth double, conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("parts", [1, 5])
def test_random_conversations(spark, parts):
    draw = random.Random(parts)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 206, 330]:  # 200 and 300 are absent
        length = 60 if c == 7 else draw.randint(1, 7)
        for turn in range(length):
            rows.append((c, turn, draw.choice(["user", "assistant"]), draw.choice(["a", "bb", "é漢x", ""])))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        assert got(trie.prefix_trie(trie.rebuilt(trie.paths(frame(spark, rows))))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_copies_and_a_common_beginning_over_many_ranges(spark):
    hello = [(turn, "user", f"hello {turn}") for turn in range(12)]
    rows = [(c, *t) for c in range(1, 60) for t in hello]  # copies
    rows += [(c, *t) for c in range(60, 200) for t in hello[: c % 13]] + [(c, 50, "user", f"then {c % 9}") for c in range(60, 200)]
    assert got(trie.prefix_trie(trie.paths(frame(spark, rows)))) == plain(rows, rebuild=False)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, None, None, None), (1, 3, "user", "x" * 200_000), (1, 3, "user", "a"), (2, None, "", ""), (7, -1, "user", "")]
    assert got(trie.prefix_trie(trie.paths(frame(spark, rows)))) == plain(rows, rebuild=False)
    assert got(trie.prefix_trie(trie.rebuilt(trie.paths(frame(spark, rows))))) == plain(rows)
    assert trie.prefix_trie(trie.paths(frame(spark, rows[:1]))).count() == 0
    gone = got(trie.prefix_trie(trie.rebuilt(trie.paths(frame(spark, [(205, 0, "user", "x")])))))  # nothing is left of it
    assert gone == plain([(205, 0, "user", "x")])
