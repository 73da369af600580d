"""Queries that no SQL covers, run as they are registered, against plain versions."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import tiktoken

from glyphstream.llm import line_dedup, queries

from test_line_dedup import plain, removed_words

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op4_encodes_every_text_as_the_library(spark):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs, rows = documents(spark), queries.op4_bpe_codec(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_op5_removes_what_a_plain_search_finds(spark):
    docs, rows = documents(spark), queries.op5_line_dedup(spark, SF).collect()
    want = plain(list(docs.items()), line_dedup.Settings().least)
    assert sorted(r.doc_id for r in rows) == sorted(docs) and any(want.values())
    for r in rows:
        assert removed_words(docs[r.doc_id], r.removed_runs) == want[r.doc_id], r.doc_id


def test_op3_finds_toxic_documents_that_were_held_out(spark):
    sf = "/root/testdata/sf0.1"  # 1,300 held-out labels, 150 of them toxic; sf0.01 has 18
    rows = {r.doc_id: r for r in queries.op3_toxicity_crf(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(labels[i], rows[i].predicted) for i in labels if rows[i].held_out]
    toxic, clean = [p for y, p in held if y], [p for y, p in held if not y]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.03 * len(clean)
