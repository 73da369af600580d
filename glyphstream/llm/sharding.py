"""Sharding by histogram sort: shards of near equal bytes under one total order.

Rows are ordered by (hash of the text, hash of the id, row number), so equal
texts are neighbours and stay in one shard unless a splitter must fall among
them. The splitters are found by exact counts, not by a sample: each round
sums, in one map-side combined aggregation, the bytes in every bucket between
candidate boundaries, keeps a boundary that meets the tolerance, and else
lays new candidates inside the bucket that holds the target. A bucket with one
text alone is refined by ids, then by row numbers, so a text that holds a third
of all rows is split like anything else. A shard is cut into ``cuts`` parts by
splitters of the same kind; then every row, whole, is exchanged once, straight to
the partition that the splitters name. Slots come from exact row counts of
a shard's parts before.

Only ``buckets`` sums for each splitter ever reach the driver.

Edge cases: null text has no bytes (size 8, checksum 0) and hashes like the
empty text; with fewer rows than shards some shards stay empty; repeated rows
and rows without id get slots of their own; extra columns are ignored, or kept
where they are asked for (those named like a column of the result can't be);
very long texts move only if they are kept; an empty table gives an empty
table, and no files.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.runtime import materialize

TOP = 1 << 62
_DIMENSIONS = ("h", "d", "r")


@dataclass(frozen=True)
class Span:
    """Keys that share ``fixed`` and have the next dimension in [lo, hi)."""

    fixed: tuple[int, ...]
    lo: int
    hi: int

    def step(self, buckets: int) -> int:
        return -(-(self.hi - self.lo) // buckets)

    def holds(self) -> Column:
        own = F.col(_DIMENSIONS[len(self.fixed)])
        inside = (own >= F.lit(self.lo)) & (own < F.lit(self.hi))
        for name, value in zip(_DIMENSIONS, self.fixed):
            inside = (F.col(name) == F.lit(value)) & inside
        return inside

    def edge(self, at: int) -> tuple[int, int, int]:
        return (*self.fixed, at, 0, 0)[:3]


@dataclass(frozen=True)
class Probe:
    """Where a splitter is looked for, and the exact bytes below that span."""

    span: Span
    below: int
    target: int


def keys(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: list[str] | None = None) -> DataFrame:
    """Id, size, checksum and order key (h, d, r) of every row; 62 bits each, so differences fit a long. And the columns to keep."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    high = lambda c: F.shiftrightunsigned(F.xxhash64(c), 2)
    return df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        high(text).alias("h"),
        high(F.col(id_col)).alias("d"),
        F.monotonically_increasing_id().alias("r"),
        *(kept or []),
    )


def _histogram(rows: DataFrame, spans: list[Span], buckets: int) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """(span, bucket) to (bytes, rows, least, greatest value) for every bucket with rows."""
    which, value = F, F
    for i, span in enumerate(spans):
        which = which.when(span.holds(), F.lit(i))
        own = F.col(_DIMENSIONS[len(span.fixed)])
        value = value.when(span.holds(), own)
    step, lo = F, F
    for i, span in enumerate(spans):
        step = step.when(F.col("span") == i, F.lit(span.step(buckets)))
        lo = lo.when(F.col("span") == i, F.lit(span.lo))
    sums = (
        rows.select(which.alias("span"), value.alias("value"), "size")
        .where("span is not null")
        .select("span", "value", "size", F.call_function("div", F.col("value") - lo, step).alias("bucket"))
        .groupBy("span", "bucket")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    )
    return {(r.span, r.bucket): (r.bytes, r.n, r.least, r.most) for r in sums.collect()}


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.001, buckets: int = 1024) -> list[tuple[int, int, int]]:
    """Keys at which shards 1, 2, ... begin. ``tolerance`` is a share of a shard's bytes;
    a boundary misses its target by more only where one row is larger than that."""
    got = rows.agg(F.sum("size").alias("bytes"), F.max("r").alias("r")).first()
    total, last = got.bytes or 0, (got.r or 0) + 1
    allowed = tolerance * total / shards
    open_ = {k: Probe(Span((), 0, TOP), 0, total * k // shards) for k in range(1, shards)} if total else {}
    found: dict[int, tuple[int, int, int]] = {k: (TOP, 0, 0) for k in range(1, shards)}
    while open_:
        spans = list(dict.fromkeys(p.span for p in open_.values()))
        sums = _histogram(rows, spans, buckets)
        still: dict[int, Probe] = {}
        for k, p in open_.items():
            i, below = spans.index(p.span), p.below
            for j in sorted(b for s, b in sums if s == i):
                size, n, least, most = sums[i, j]
                if below + size >= p.target:
                    break
                below += size
            before, after = p.target - below, below + size - p.target
            if min(before, after) <= allowed or n == 1:
                found[k] = p.span.edge(least if before <= after else most + 1)
            elif least < most:
                still[k] = replace(p, span=Span(p.span.fixed, least, most + 1), below=below)
            else:
                deeper = (*p.span.fixed, least)
                still[k] = replace(p, span=Span(deeper, 0, TOP if len(deeper) == 1 else last), below=below)
        open_ = still
    return [found[k] for k in sorted(found)]


def shard_of(bounds: list[tuple[int, int, int]]) -> Column:
    """The number of splitters at or below the row's key, by one look into their sorted array."""
    names = lambda values: F.struct(*(v.cast("long").alias(n) for n, v in zip(_DIMENSIONS, values)))
    all_ = F.array(*(names(map(F.lit, b)) for b in sorted(bounds))) if bounds else F.array().cast("array<struct<h:bigint,d:bigint,r:bigint>>")
    key = names(map(F.col, _DIMENSIONS))
    return F.size(F.filter(all_, lambda b: b <= key))


def shard(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``shard`` and its gapless ``slot`` there, and the columns to keep."""
    kept = [c for c in keep or [] if c != id_col]
    if clash := sorted({"id", "size", "text_crc32", "shard", "slot", "h", "d", "r"} & {*kept}):
        raise ValueError(f"columns named like the result's: {clash}")
    whole = keys(df, id_col, text_col, kept)
    narrow = materialize(whole.select("h", "d", "r", "size"), "shard-keys")
    cuts = -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    part = shard_of(splitters(narrow, shards * cuts, tolerance * cuts))
    sent = (
        whole.withColumn("part", part)
        .repartitionById(shards * cuts, F.col("part"))
        .sortWithinPartitions("h", "d", "r")
        .select("id", "size", "text_crc32", "part", F.monotonically_increasing_id().alias("at"), *kept)
    )
    sent = materialize(sent, "shard-rows")
    runs = sent.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # one row a part
    runs = runs.withColumn("shard", F.floor(F.col("part") / cuts).cast("int"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", "shard", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return sent.join(F.broadcast(runs), "part").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("base") + F.col("at") - F.col("first")).alias("slot"), *kept
    )


def write_shards(df: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001) -> None:
    """Write whole rows into one folder per shard (``shard=0`` on), with their ``slot``; rows are exchanged once, in ``shard``."""
    shard(df, shards, id_col, text_col, tolerance, df.columns).write.partitionBy("shard").parquet(path)
