"""Byte-level BPE encoding and decoding with the tiktoken library.

Long texts are cut at boundaries that the pre-splitting pattern can never
cross, so the pieces encode exactly as the whole text would. The same cuts
take the pattern's only look-ahead (``\\s+(?!\\S)``) out of the search: a run
of two or more white-space characters before a visible one is cut before the
run and before its last character, after which plain ``\\s+`` finds the same
matches, and does so in the library's faster search without backtracking.

Token ids are kept as a binary column of little-endian unsigned 32-bit
integers: compact in Parquet, and hashed natively by ``sha2`` and ``crc32``.

Edge cases: null text is an empty text; an empty text has no ids and decodes to
no bytes; white-space-only texts and texts of one long word are encoded whole;
repeated rows give repeated results; extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import base64
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The code points of Unicode's White_Space property, as the library's \s has them.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUN = regex.compile(f"[{WHITE}]{{2,}}(?=[^{WHITE}])")
_SAFE = regex.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
_LOOKAHEAD = r"|\s+(?!\S)"
#: Texts over this many code points are cut.
PIECE = 1 << 16


class Codec:
    """A tiktoken encoding of a local rank file, cut at safe boundaries.

    ``added`` names a file of the ``tokenizers`` library: texts are then split at its added
    tokens, each of which is its own id, as that library does.
    """

    def __init__(self, ranks_path: str, pattern: str, added: str | None = None):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cuts_runs = _LOOKAHEAD in pattern
        self.encoding = tiktoken.Encoding(
            "local", pat_str=pattern.replace(_LOOKAHEAD, ""), mergeable_ranks=ranks, special_tokens={}
        )
        self.added = added_tokens(added) if added else {}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        words = {i: word for word, i in ranks.items()} | {i: word.encode() for word, i in self.added.items()}
        self.words: list[bytes] = [words.get(i, b"") for i in range(max(words) + 1)]

    def encode(self, text: str) -> list[int]:
        if self.split is None or (first := self.split.search(text)) is None:
            return self._encode_plain(text)
        ids, at = [], 0
        for m in self.split.finditer(text, first.start()):
            ids += self._encode_plain(text[at : m.start()])
            ids.append(self.added[m.group()])
            at = m.end()
        return ids + self._encode_plain(text[at:])

    def _encode_plain(self, text: str) -> list[int]:
        if len(text) <= PIECE:
            return self._encode_piece(text)
        ids: list[int] = []
        for piece in safe_pieces(text):
            ids += self._encode_piece(piece)
        return ids

    def _encode_piece(self, text: str) -> list[int]:
        encode = self.encoding.encode_ordinary
        if not self.cuts_runs or (first := _RUN.search(text)) is None:
            return encode(text)
        ids, at = [], 0
        for m in _RUN.finditer(text, first.start()):
            ids += encode(text[at : m.start()])
            ids += encode(text[m.start() : m.end() - 1])
            at = m.end() - 1
        return ids + encode(text[at:])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` file and their ids; only tokens that match as they stand."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    for t in held["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] and held["normalizer"]:
            raise ValueError(f"added token {t['content']!r} doesn't match as it stands")
    return {t["content"]: t["id"] for t in held["added_tokens"]}


def safe_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cut at the first visible-to-white boundary after every ``size`` code points.

    No alternative of the pattern matches a visible character followed by a
    white one, and its look-ahead only looks past white space, so the matches on
    both sides of such a boundary are those of the whole text.
    """
    at = 0
    while len(text) - at > size and (m := _SAFE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str, added: str | None = None) -> Codec:
    return Codec(ranks_path, pattern, added)


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers (array 'I' on any Spark platform)."""
    return array("I", ids).tobytes()


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: the id column, ``n_tokens`` and ``token_ids``."""
    narrow = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = T.StructType([
        T.StructField(id_col, narrow.schema[0].dataType),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("token_ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = [own.encode(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(map(packed, ids), pa.binary())],
                    names=schema.names,
                )

    return narrow.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Every column of ``df``, and the raw bytes that the ids stand for.

    Bytes, not text: a cut sequence of ids may end inside a character. Null ids
    decode to no bytes. A column already named ``out_col`` is replaced.
    """
    kept = df.drop(out_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.BinaryType())])
    at_ids = kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = (own.decode(array("I", x or b"")) for x in batch.column(at_ids).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return kept.mapInArrow(run, schema)
