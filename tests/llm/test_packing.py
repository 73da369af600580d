import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from glyphstream.llm import packing, queries

RANKS, ADDED = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def lengths_of_pieces(n, size):
    return [n] if n <= size else ([n % size] if n % size else []) + [size] * (n // size)


def hold(rows, texts, size):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(pieces[doc], key=lambda r: r.piece)
        assert [r.length for r in own] == lengths_of_pieces(len(ids), size)
        for r in own:
            assert r.ids_crc32 == crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for laid in bins.values():
        at = 0
        for offset, length in sorted(laid):
            assert offset == at
            at += length
        assert 0 < at <= size
    return len(bins)


def test_pack(spark):
    rng = random.Random(3)
    texts = [(0, None), (1, ""), (2, "a b " * 5000), (3, "x" * 30000), (4, "<|endoftext|> twice"), (5, "\n\n  odd  spaces \n")]
    texts += [(i, " ".join(rng.choice(["alpha", "beta", "über", "12"]) for _ in range(rng.randint(1, 90)))) for i in range(6, 400)]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, piece int").repartition(7)
    rows = packing.pack(df, RANKS, P.PATTERN, 2, size=128, group=60, added=ADDED).collect()
    used = hold(rows, texts, 128)
    total = sum(r.length for r in rows)
    assert used <= 1.05 * total / 128 + 2
    kept = packing.pack(df, RANKS, P.PATTERN, 2, size=128, keep_ids=True, added=ADDED)
    whole = packing.sequences(kept).collect()
    assert sum(r.n_tokens for r in whole) == total and all(len(r.token_ids) == 4 * r.n_tokens for r in whole)
    assert packing.pack(df.limit(0), RANKS, P.PATTERN, 2).count() == 0


def test_repeated_rows_each_have_a_place(spark):
    df = spark.createDataFrame([(1, "same text here")] * 50, "doc_id long, text string")
    rows = packing.pack(df, RANKS, P.PATTERN, 2, size=16).collect()
    assert len(rows) == 50 and len({(r.sequence_id, r.offset) for r in rows}) == 50


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fill = packing.best_fit([6, 5, 3, 4], 10)
    assert bins[3] == bins[0] and bins[2] == bins[1] and fill == [10, 8]


def test_underfull_bins_rise_as_items():
    """Bins that fit together stay laid as they are; what stays underfull is opened."""
    bins, offsets, fill = packing.merge([7, 7, 9, 4, 4], [3, 2, 5, 4, 3], [0, 3, 0, 0, 4], 10, 9.9)
    assert bins[0] == bins[1] == bins[2] and offsets[1] - offsets[0] == 3 and {offsets[0], offsets[2]} == {0, 5}
    assert bins[3] == bins[4] != bins[0] and sorted(n for n in fill if n) == [7, 7, 10]


def test_levels_that_emit_little_end(spark):
    """Pieces over half a sequence never fit together: the levels stop, and each piece is a sequence."""
    df = spark.createDataFrame([(i, "a b c d e f g h i j"[: 13 + 2 * (i % 3)]) for i in range(200)], "doc_id long, text string")
    rows = packing.pack(df, RANKS, P.PATTERN, 2, size=13, group=20).collect()
    assert len(rows) == 200 and len({r.sequence_id for r in rows}) == 200 and {r.offset for r in rows} == {0}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op6_best_fit_packing(spark, sf).collect()
    assert hold(rows, texts, 1024) <= 1.01 * sum(r.length for r in rows) / 1024 + 1
