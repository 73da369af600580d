"""Column expressions over symbol sequences (letters A, C, G, T, N and gaps).

Undefined results are null, never NaN. Three normalisers differ on purpose:
``normalized`` keeps white space, ``cleaned`` drops it, ``gapless`` also drops
gaps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How texts become sequences here (letters cyclically to ACGT, digits to N, gaps kept).
SOURCE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
TARGET = "ACGTACGTACGTACGTACGTACGTAC" * 2 + "N" * 10
SYMBOLS = "ACGT"
#: Plain characters that no sequence has; a look-up drops them faster than a pattern.
DROPPED = "".join(chr(c) for c in range(1, 128) if chr(c) not in SOURCE + "-")
#: The same mapping of UTF-8 bytes, and the bytes that it drops: all bytes of longer characters are among them.
BYTES, NO_BYTES = bytes.maketrans(SOURCE.encode(), TARGET.encode()), bytes(c for c in range(256) if chr(c) not in SOURCE + "-")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def encoded(text: Column) -> Column:
    """A text as a sequence, by character mapping alone."""
    return F.regexp_replace(F.translate(text, SOURCE + DROPPED, TARGET), "[^ACGTN-]+", "")


def encoded_bytes(text: bytes | None) -> str:
    """:func:`encoded` in tasks that hold a text's UTF-8 bytes; null is empty."""
    return (text or b"").translate(BYTES, NO_BYTES).decode("ascii")


def normalized(s: Column) -> Column:
    return F.translate(F.upper(s), "U", "T")


def cleaned(s: Column) -> Column:
    return F.translate(F.upper(F.regexp_replace(s, "\\s+", "")), "U", "T")


def gapless(s: Column, drop_gaps: bool = True) -> Column:
    return F.replace(cleaned(s), F.lit("-"), F.lit("")) if drop_gaps else cleaned(s)


def count_of(s: Column, symbols: str) -> Column:
    """How many characters of ``s`` are among ``symbols``."""
    return F.length(s) - F.length(F.translate(s, symbols, ""))


def ambiguous_fraction(s: Column) -> Column:
    """Share of characters other than A, C, G, T; 1 for an empty sequence."""
    return F.coalesce(F.try_divide(F.length(F.translate(s, SYMBOLS, "")), F.length(s)), F.lit(1.0))


def invalid_count(s: Column) -> Column:
    return F.length(F.translate(s, SYMBOLS + "N", ""))


def gc_content(s: Column) -> Column:
    """(G + C) over the A, C, G, T of the sequence; null without any."""
    return F.try_divide(count_of(s, "GC"), count_of(s, SYMBOLS))


def every_window(s: Column, k: int) -> Column:
    """What begins at each place of a sequence: ``k`` symbols, fewer at its end. All shorter k-mers are beginnings of these."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{1,{k}}}))."), F.lit(1))


def overlapping(s: Column, k: int) -> Column:
    """All k-symbol tokens at step 1, as an array. A look-ahead keeps this linear in the length."""
    return F.regexp_extract_all(s, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def stepped(s: Column, k: int, offset: int = 0) -> Column:
    """Whole k-symbol tokens at step k from ``offset``; none for k below 1."""
    if k < 1:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(F.substr(s, F.lit(offset + 1)), F.lit(f".{{{k}}}"), F.lit(0))


def crosses_boundary(start: Column, end: Column, frame: int = 0) -> Column:
    """Whether a codon boundary of the frame lies strictly inside [start, end)."""
    return F.floor((end - 1 - frame) / 3) > F.floor((start - frame) / 3)


def has_cg(token: Column) -> Column:
    return normalized(token).contains("CG")


def has_ta(token: Column) -> Column:
    return normalized(token).contains("TA")


def entropy_term(p: Column) -> Column:
    """-p log2 p, to be summed."""
    return -p * F.log2(p)


def stable_id(*parts: Column, prefix: str = "gs") -> Column:
    """prefix_ and 16 hex digits of the SHA-256 of the parts joined by bars; null parts are empty."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 16))


def salted_id(value: Column, salt: str, prefix: str, digits: int) -> Column:
    """A salted hash for ids that leave the house."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat(F.lit(salt + "::"), value.cast("string")), 256), 1, digits))


def sha_rank(seed: int, *keys: Column) -> Column:
    """Order key of a reproducible shuffle: SHA-256 of seed and keys, equal in any engine and layout."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)), 256)


def year_bin(year: Column, edges: list[int]) -> Column:
    """Right-closed bins labelled by their upper edge; ``unknown`` for null."""
    label = F.when(year.isNull(), F.lit("unknown"))
    for e in edges:
        label = label.when(year <= e, F.lit(f"<={e}"))
    return label.otherwise(F.lit(f">{edges[-1]}"))


def finite(x: Column, digits: int = 6) -> Column:
    """Null for what isn't finite, else rounded."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(F.round(x, digits))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays; 1 for an empty union."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
