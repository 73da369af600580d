"""Best-fit packing of tokenised documents into sequences of bounded length.

Hierarchical residual packing. Level 0 tokenises each partition once and packs
its pieces best-fit, longest first; bins that are nearly full are emitted, with
whole-length pieces as bins of their own. Underfull bins go up as
items: they are dealt whole into groups of bounded size and packed best-fit again, a bin as one
item. Bins that are nearly full by then are emitted as they are. A bin over half full
can't be joined with another such bin, so what is still underfull is opened, and its pieces are packed best-fit once
more within the group. What is nearly full now is emitted and the rest goes up as bins again,
until one group holds all that is left. If a level has emitted less than a tenth of its pieces, further levels
would not help and each group emits what it has. No task holds more than about ``group`` pieces, and
only piece metadata moves between levels unless the ids are asked for.

A document is its token ids and one closing id. Only documents longer than a
sequence are cut: the first piece takes the remainder, the rest are full.

Edge cases: null text is an empty text, which is a document of the closing id
alone; very long texts stream in blocks; repeated rows and rows without id are packed like any
others, each in its own place; extra columns are ignored; an empty table gives
an empty table. ``sequences`` gives no row for no pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphstream.llm.bpe import codec, packed
from glyphstream.runtime import materialize

#: Pieces that one best-fit call handles at most.
GROUP = 100_000
#: A bin of at least this share of the sequence length is emitted at once.
NEARLY_FULL = 0.996


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: the bin and offset of each item, and each bin's fill.

    Open bins are stacked by free space, and a bit mask tells which stacks have
    bins, so the tightest fit of an item is the lowest set bit at its length.
    """
    order = sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)
    bins, offsets, fill = [0] * len(lengths), [0] * len(lengths), []
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0
    for i in order:
        need = lengths[i]
        if open_ := mask >> need:
            free = need + (open_ & -open_).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                mask &= ~(1 << free)
        else:
            free, b = size, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += need
        if left := free - need:
            stacks[left].append(b)
            mask |= 1 << left
    return bins, offsets, fill


def merge(bins: list[int], lengths: list[int], offsets: list[int], size: int, least: float) -> tuple[list[int], list[int], list[int]]:
    """The bin and offset of each piece, and each bin's fill, after two rounds over pieces laid in underfull bins:
    best-fit of the bins as items, then best-fit of the pieces of the bins that are still underfull."""
    names = {b: i for i, b in enumerate(dict.fromkeys(bins))}
    fills = [0] * len(names)
    for b, n in zip(bins, lengths):
        fills[names[b]] += n
    of_bin, at_bin, fill = best_fit(fills, size)
    placed = [of_bin[names[b]] for b in bins]
    offsets = [at_bin[names[b]] + o for b, o in zip(bins, offsets)]
    opened = [i for i, b in enumerate(placed) if fill[b] < least]
    again, at, fill_again = best_fit([lengths[i] for i in opened], size)
    for i, b, o in zip(opened, again, at):
        placed[i], offsets[i] = len(fill) + b, o
    return placed, offsets, fill + fill_again


def _ids(level: int) -> Iterator[int]:
    """Sequence numbers that no other task or level gives."""
    at = level << 58 | TaskContext.get().partitionId() << 34
    while True:
        yield at
        at += 1


def pieces_of(ids: list[int], size: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length) of a document of so many ids."""
    n = len(ids)
    start, piece = 0, 0
    while start < n:
        length = n if n <= size else (n - start) % size or size
        yield piece, start, length
        start, piece = start + length, piece + 1


def pack(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    closing_id: int,
    size: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
    group: int = GROUP,
    added: str | None = None,
) -> DataFrame:
    """One row per piece with its place: ``sequence_id`` and ``offset``.

    ``added`` names the ``tokenizers`` file whose added tokens are ids of their own in the texts.

    ``keep_ids`` adds the piece's ids as little-endian unsigned 32-bit integers
    (``token_ids``); ``sequences`` joins them to whole sequences.
    """
    narrow = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = T.StructType([
        T.StructField(id_col, narrow.schema[0].dataType),
        T.StructField("piece", T.IntegerType()),
        *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset")),
        *([T.StructField("token_ids", T.BinaryType())] if keep_ids else []),
    ])
    inner = T.StructType([*schema.fields, T.StructField("done", T.BooleanType())])
    names, least = inner.names, NEARLY_FULL * size
    kinds = [None, pa.int32(), *[pa.int64()] * 5, *([pa.binary()] if keep_ids else []), pa.bool_()]

    def out(rows: list[list], bins: list[int], offsets: list[int], fill: list[int], new_id: Iterator[int], emit: float, key: pa.DataType) -> Iterator[pa.RecordBatch]:
        ids = [next(new_id) for _ in fill]
        for row, b, offset in zip(rows, bins, offsets):
            row[5:7], row[-1] = (ids[b], offset), fill[b] >= emit
        for at in range(0, len(rows), 10_000):
            columns = zip(*rows[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, k or key) for c, k in zip(columns, kinds)], names=names)

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, new_id, key, rows = codec(ranks_path, pattern, added), _ids(0), pa.int64(), []
        for whole in batches:
            key = whole.schema.types[0]
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = own.encode(text)
                    ids.append(closing_id)
                    raw = packed(ids)
                    for piece, start, length in pieces_of(ids, size):
                        own_raw = raw[4 * start : 4 * (start + length)]
                        rows.append([doc, piece, start, length, crc32(own_raw), None, None, *([own_raw] if keep_ids else []), False])
                if len(rows) >= group:
                    yield from out(rows, *best_fit([r[3] for r in rows], size), new_id, least, key)
                    rows = []
        yield from out(rows, *best_fit([r[3] for r in rows], size), new_id, least, key)

    def again(level: int, emit: float):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            new_id, key, rows = _ids(level), pa.int64(), []
            for batch in batches:
                key = batch.schema.types[0]
                rows += map(list, zip(*(c.to_pylist() for c in batch.columns)))
            yield from out(rows, *merge([r[5] for r in rows], [r[3] for r in rows], [r[6] for r in rows], size, least), new_id, emit, key)

        return run

    def dealt(rest: DataFrame, pieces: int) -> DataFrame:
        """Underfull bins, whole, in groups of about ``group`` pieces."""
        groups = -(-pieces // group)
        return rest.repartitionById(groups, F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).cast("int"))

    done = materialize(narrow.mapInArrow(first, inner), "packed-0")
    levels = [done.where("done")]
    rest = done.where("not done")
    left, level = rest.count(), 1
    while left:
        emit = least if left > group else 0
        done = materialize(dealt(rest, left).mapInArrow(again(level, emit), inner), f"packed-{level}")
        rest = done.where("not done")
        before, left = left, rest.count()
        if left > 0.9 * before:  # further levels would not help: each group emits what it has
            levels.append(done)
            break
        levels.append(done.where("done"))
        level += 1
    levels = [d.drop("done") for d in levels]
    packed_all = levels[0]
    for more in levels[1:]:
        packed_all = packed_all.unionByName(more)
    return packed_all


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences of ids from ``pack(..., keep_ids=True)``: at most ``size`` ids each."""
    laid = F.array_sort(F.collect_list(F.struct("offset", "token_ids")))
    joined = F.aggregate(laid, F.lit(b""), lambda all_, x: F.concat(all_, x["token_ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("token_ids"), F.sum("length").alias("n_tokens"))
