from zlib import crc32

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from glyphstream.llm import bpe, queries

TEXTS = [
    "hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a  <|endoftext|>  b\n\n<|endoftext|>\n c", "<|endoftext |> <|endoftext|",
    "plain text", "", "x" * 70_000 + " <|endoftext|>" + " word  of it" * 9000, "é<|endoftext|>ü   z",
]


def test_ids_are_those_of_the_file_as_loaded():
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own = bpe.codec(queries.PACK_RANKS, P.PATTERN, queries.PACK_ADDED)
    for text in TEXTS:
        ids = own.encode(text)
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text[:40]
        assert own.decode(ids) == text.encode()


def test_op6_packs_the_added_token_as_one_id(spark, tmp_path):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [t for t in TEXTS if len(t) < 1000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.QUERIES["op6_best_fit_packing"](spark, str(tmp_path)).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [queries.PACK_CLOSING_ID]
        assert (r.length, r.ids_crc32) == (len(ids), crc32(np.array(ids, "<u4").tobytes()))


def test_tokens_that_strip_their_surroundings_are_refused(tmp_path):
    (tmp_path / "t.json").write_text('{"normalizer": null, "added_tokens": [{"id": 9, "content": "<x>", "single_word": false, "lstrip": true, "rstrip": false, "normalized": false}]}')
    with pytest.raises(ValueError):
        bpe.added_tokens(str(tmp_path / "t.json"))
