"""Residue signals, consensus and local alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.functions import codon, sequence as q
from glyphstream.operators import tokens
from glyphstream.runtime import broadcast_if_small, materialize


def codons_at(df: DataFrame, group: list[str], seq_col: str) -> DataFrame:
    """(group, ``at``, ``codon``, ``n``): how often a codon is at an index of the group's sequences; what signals and consensus are made of."""
    return tokens.position_counts(df, 3, group, seq_col).withColumnRenamed("token", "codon")


def residue_signals(df: DataFrame, group: list[str], seq_col: str) -> DataFrame:
    """Per group and codon index: rows, means of GC, CG, TA and ambiguity, entropy and share of the dominant residue."""
    return signals_of(codons_at(df, group, seq_col), group)


def signals_of(counted: DataFrame, group: list[str]) -> DataFrame:
    """The signals of :func:`residue_signals` from counted codons."""
    c, n = F.col("codon"), F.col("n")
    each = counted.select(
        *group, "at", "n", codon.translated(c).alias("amino"), (n * q.count_of(c, "GC")).alias("gc"), (n * c.contains("CG").cast("int")).alias("cg"),
        (n * c.contains("TA").cast("int")).alias("ta"), (n * (q.count_of(c, "ACGT") < 3).cast("int")).alias("unclear"),
    )
    part = each.groupBy(*group, "at", "amino").agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in ("gc", "cg", "ta", "unclear")))
    total = F.sum("n").over(Window.partitionBy(*group, "at"))
    part = part.withColumn("p", F.col("n") / total)
    mean = lambda x: (F.sum(x) / F.sum("n")).alias(x)
    gc = (F.sum("gc") / (3 * F.sum("n"))).alias("gc")  # whole numbers until the last step, whatever the order
    return part.groupBy(*group, "at").agg(F.sum("n").alias("n"), gc, mean("cg"), mean("ta"), mean("unclear"), F.sum(q.entropy_term(F.col("p"))).alias("entropy"), F.max("p").alias("dominant"))


def consensus(df: DataFrame, group: str, amino_col: str) -> DataFrame:
    """The most frequent residue of every position, without stops and X, ties to the smaller; X where none is left."""
    return _most_frequent(tokens.position_counts(df, 1, [group], amino_col).withColumnRenamed("token", "residue"), group)


def consensus_of(counted: DataFrame, group: str) -> DataFrame:
    """The consensus of the translations of counted codons."""
    residues = counted.select(group, "at", codon.translated(F.col("codon")).alias("residue"), "n")
    return _most_frequent(residues.groupBy(group, "at", "residue").agg(F.sum("n").alias("n")), group)


def _most_frequent(n: DataFrame, group: str) -> DataFrame:
    clear = ~F.col("residue").isin("*", "X")
    best = n.groupBy(group, "at").agg(F.coalesce(F.max_by(F.when(clear, F.col("residue")), F.when(clear, F.struct("n", -F.ascii("residue")))), F.lit("X")).alias("residue"))
    laid = F.array_sort(F.collect_list(F.struct("at", "residue")))
    return best.groupBy(group).agg(F.array_join(F.transform(laid, lambda x: x["residue"]), "").alias("consensus"))


#: Cells of directions that a traceback holds at once, a byte each; a larger block of rows is cut, and CUTS of its rows are kept.
CELLS, CUTS = 1 << 25, 64


class _Rows:
    """The cells of an affine-gap local alignment, row after row; a state is (best, gap in b) of one row."""

    def __init__(self, a: str, b: str, match: float, mismatch: float, open_: float, extend: float):
        self.a, self.b = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (a, b))
        self.match, self.mismatch, self.open, self.extend = match, mismatch, open_, extend
        self.slope = np.arange(len(self.b) + 1) * extend

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(len(self.b) + 1), np.full(len(self.b) + 1, -np.inf)

    def step(self, i: int, state: tuple[np.ndarray, np.ndarray], m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row i (from 1) of columns 0 to m: best, gap_a, gap_b. A gap in a is the greatest of all its openings, as a running maximum."""
        above, gap = state[0][: m + 1], state[1][: m + 1]
        gap_a = np.maximum(above + self.open, gap + self.extend)
        gap_a[0] = -np.inf
        best = np.zeros(m + 1)
        best[1:] = above[:-1] + np.where(self.b[:m] == self.a[i - 1], self.match, self.mismatch)
        np.maximum(best, gap_a, out=best)
        np.maximum(best, 0, out=best)
        best[0] = 0
        gap_b = np.full(m + 1, -np.inf)
        gap_b[1:] = np.maximum.accumulate(best[:-1] - self.slope[:m]) + self.slope[:m] + self.open
        np.maximum(best, gap_b, out=best)
        return best, gap_a, gap_b


def local_alignment(a: str, b: str, match: float = 2, mismatch: float = -1, open_: float = -10, extend: float = -0.5) -> tuple[float, list[tuple[int, int]]]:
    """Best local alignment with affine gaps (opening costs no less than extending): score and aligned
    index pairs; the first best cell by row, then column.

    One row at a time is held; the traceback makes the rows again in blocks of at most ``CELLS`` cells.
    """
    rows = _Rows(a, b, match, mismatch, open_, extend)
    score, end, state = 0.0, (0, 0), rows.first()
    kept, every = [state], max(1, -(-len(a) // CUTS))
    for i in range(1, len(a) + 1):
        best, gap_a, _ = rows.step(i, state, len(b))
        state = best, gap_a
        j = int(best.argmax())
        if best[j] > score:
            score, end = float(best[j]), (i, j)
        if i % every == 0:
            kept.append(state)
    pairs: list[tuple[int, int]] = []
    at = (*end, "m")  # row, column, state; the row is 0 where the alignment has begun
    del kept[-(-end[0] // every) :]
    while kept and at[0]:
        state = kept.pop()
        at = _back(rows, len(kept) * every, state, at, pairs)
    return score, pairs[::-1]


def _back(rows: _Rows, low: int, state: tuple[np.ndarray, np.ndarray], at: tuple[int, int, str], pairs: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Follow the alignment from cell ``at`` up to row ``low``, whose state is given."""
    i, j, kind = at
    if i - low > 1 and (i - low) * (j + 1) > CELLS:
        kept, every = [state], -(-(i - low) // CUTS)
        for r in range(low + 1, i):
            state = rows.step(r, state, j)[:2]
            if (r - low) % every == 0:
                kept.append(state)
        while kept and at[0]:
            state = kept.pop()
            at = _back(rows, low + len(kept) * every, state, at, pairs)
        return at
    ways = np.zeros((i - low, j + 1), np.uint8)  # bits: ends in a gap of b, of a; those gaps open here; nothing before
    for r in range(low + 1, i + 1):
        above = state[0][: j + 1]
        best, gap_a, gap_b = rows.step(r, state, j)
        way = (best == gap_a) | (best == gap_b) * np.uint8(2) | (gap_a == above + rows.open) * np.uint8(4) | (best <= 0) * np.uint8(16)
        way[1:] |= (gap_b[1:] <= best[:-1] + rows.open) * np.uint8(8)
        ways[r - low - 1] = way
        state = best, gap_a
    while i > low and j:
        way = ways[i - low - 1, j]
        if kind == "m":
            if way & 16:
                return 0, 0, "m"
            if way & 1:
                kind = "a"
            elif way & 2:
                kind = "b"
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        elif kind == "a":
            kind = "m" if way & 4 else "a"
            i -= 1
        else:
            kind = "m" if way & 8 else "b"
            j -= 1
    return (i, j, kind) if i and j else (0, 0, "m")


def aligned(pairs: DataFrame, key: str, a_col: str, b_col: str) -> DataFrame:
    """(key, score, identity, coverage, a_at, b_at): alignment of each row's two strings, as index arrays.

    Rows are few and each is long work, so they are dealt out one by one before."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, a, b in zip(f[key], f[a_col], f[b_col]):
                score, at = local_alignment(a or "", b or "")
                same = sum(a[i] == b[j] for i, j in at)
                rows.append((k, score, same / len(at) if at else 0.0, len(at) / len(a) if a else 0.0, [i for i, _ in at], [j for _, j in at]))
            yield pd.DataFrame(rows, columns=[key, "score", "identity", "coverage", "a_at", "b_at"])

    kind = dict(pairs.dtypes)[key]
    dealt = pairs.select(key, a_col, b_col).repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInPandas(run, f"{key} {kind}, score double, identity double, coverage double, a_at array<int>, b_at array<int>")


def mapped_signals(maps: DataFrame, signals: DataFrame, group: str, key: str) -> DataFrame:
    """Aligned positions of each row joined to the signals of their group and position, misses kept."""
    each = maps.select(key, group, F.explode(F.arrays_zip("a_at", "b_at")).alias("p")).select(key, group, F.col("p.a_at").alias("structure_at"), F.col("p.b_at").alias("at"))
    return each.join(signals, [group, "at"], "left")


ENTRY = ["structure", "entity", "chains", "subtype", "protein"]


def structure_tables(entries: DataFrame, consensus_: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quality rows and mapped positions of structure entries (``ENTRY`` and ``sequence``), each against its own group's consensus.

    ``consensus_`` has (subtype, protein, consensus), ``signals`` (subtype, protein, group, at, ...) with positions from 1. Every entry has a quality row: lengths,
    identity (null where nothing is mapped), mapped positions, both coverages, the first and last local position, and a status;
    one without consensus or sequence is ``unmapped``. A mapped position has both indexes, from 1, and the signals that subtype, protein, group and
    position name, null where there are none. Pairs of an entry and a consensus are aligned in tasks, a string of each at a time.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    pairs = entries.join(broadcast_if_small(consensus_), ["subtype", "protein"], "left").select(*ENTRY, text("sequence").alias("sequence"), text("consensus").alias("consensus"))
    pairs = materialize(pairs.withColumn("pair", F.to_json(F.struct(*ENTRY), {"ignoreNullFields": "false"})), "pairs")
    found = materialize(aligned(pairs, "pair", "consensus", "sequence"), "aligned")
    both, n = pairs.join(found, "pair"), F.size("a_at").cast("long")
    some = lambda c: F.when(n > 0, c)
    qc = both.select(
        *ENTRY, F.length("sequence").cast("long").alias("structure_length"), F.length("consensus").cast("long").alias("consensus_length"), some(F.col("identity")).alias("identity"), n.alias("n_mapped"),
        F.coalesce(F.try_divide(n, F.length("sequence")), F.lit(0.0)).alias("coverage_structure"), F.coalesce(F.try_divide(n, F.length("consensus")), F.lit(0.0)).alias("coverage_local"),
        some(F.array_min("a_at") + 1).cast("long").alias("local_start"), some(F.array_max("a_at") + 1).cast("long").alias("local_end"), F.when(n > 0, "alignment_qc_available").otherwise("unmapped").alias("status"),
    )
    each = both.select(*ENTRY, F.concat_ws("-", "protein", "subtype").alias("group"), F.explode(F.arrays_zip("a_at", "b_at")).alias("p"))
    each = each.select(*ENTRY, "group", (F.col("p.a_at") + 1).alias("at"), (F.col("p.b_at") + 1).alias("structure_at"))
    return qc, each.join(broadcast_if_small(signals), ["subtype", "protein", "group", "at"], "left")
