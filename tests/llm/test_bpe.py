import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from glyphstream.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    import base64

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_cuts_keep_the_encoding(plain):
    rng = random.Random(7)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "1", "22", ".", "'s", "'", "　", "\x1c", "\x85", "漢", "🙂", "<|endoftext|>"]
    own = bpe.codec(RANKS, P.PATTERN)
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 120)))
        want = plain.encode_ordinary(text)
        assert own.encode(text) == want
        assert [i for p in bpe.safe_pieces(text, 20) for i in own._encode_piece(p)] == want
        assert own.decode(want) == text.encode()


def test_operator_on_edge_rows(spark, plain):
    texts = [None, "", " \n ", "x" * 200_000, "long text here " * 20_000, "same", "same"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        want = plain.encode_ordinary(t or "")
        assert got[i].n_tokens == len(want)
        assert hashlib.sha256(got[i].token_ids).digest() == hashlib.sha256(np.array(want, "<u4").tobytes()).digest()
        assert got[i].decoded.decode() == (t or "")
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0
