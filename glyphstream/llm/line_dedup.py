"""Line deduplication by winnowing.

Two kinds of repeats go, both from the later place; the first place keeps them.

1. Passages. They repeat in the middle of physical lines too, so a line here is
   ``line`` words in a row, beginning at any word. Of every ``window``
   neighbouring line hashes the least is a fingerprint; any run of
   ``line + window - 1`` shared words therefore has a fingerprint in common.
   Fingerprints are joined with their first place in the corpus (or the previous
   one in the same document), matches on one diagonal of two texts are extended
   both ways word by word, and every repeated run of at least ``least`` words goes.
2. Physical lines: a line of ``short`` words or more whose words, in order, were
   a physical line before goes, whatever its length. Lines of ``least`` words are
   found as passages anyway.

A fingerprint at three places or more has earlier places that step 1 doesn't try.
There, all runs of ``least`` words that hold it and don't lie in a run already
found are hashed and joined with their own first place: equal runs are long
enough as they are, so one partner decides, and the result is that of a
comparison with every earlier place. (The first place of a run never lies
in a found run, as that would be an earlier one.)

What moves: fingerprints (about 6 % of the words) and a hash for each physical
line, the texts of documents with matches, for each match the source's words
around it (at most six times the text, none for matches within a text), and at
most ``least - line + 1`` runs around a fingerprint at three places or more.
Each is paired with its first place alone, and frequent ones are joined by
broadcast, so a passage that a third of all documents share makes one row each.
Runs and physical lines are equal if two 64-bit hashes of their words are.

Documents are ordered by id. Edge cases: null texts stay null; empty texts stay
as they are; a text that is repeated whole becomes empty; rows that share an id
are one document, and the later of them is no repeat; rows without id stay as
they are; very long texts are hashed in a few vector passes; extra columns are
kept, but one named ``removed_runs`` is replaced; an empty table gives an empty
table. The order of a text's words and the line breaks between what stays are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphstream.llm.hashing import chunks, mix, run_hashes, sums_of, word_hashes
from glyphstream.llm.quality import words_of
from glyphstream.runtime import materialize, skew_join

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Ids that are broadcast at most: 8 bytes each, about 32 MB as a hash relation.
BROADCAST_IDS = 250_000
#: What tells a second, independent word hash from the first.
_OTHER = np.uint64(0xA5A5A5A55A5A5A5A)


@dataclass(frozen=True)
class Settings:
    line: int = 10
    window: int = 32
    least: int = 50
    short: int = 1

    @property
    def margin(self) -> int:
        """Words beyond a match that can hold no further fingerprint of the same run, or that a run of ``least`` words can reach."""
        return max(self.line + self.window, self.least - self.line)


def _least_of_windows(x: np.ndarray, w: int) -> np.ndarray:
    """The least of x[i : i + w] for every i, in linear time: prefix and suffix minima of blocks of w."""
    n = len(x)
    padded = np.full(-(-(n + w) // w) * w, _NONE, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : n + w - 1])


def winnow(words: np.ndarray, counts: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position in it and hash of each fingerprint, by text and position."""
    runs = run_hashes(words, s.line)
    sizes = np.maximum(counts - s.line + 1, 0)
    first = np.cumsum(counts) - counts
    gaps = np.cumsum(sizes + s.window) - sizes  # before each text a window without lines
    laid = np.full(int((sizes + s.window).sum()) + s.window, _NONE, np.uint64)
    inside = np.repeat(gaps - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    laid[inside] = runs[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    least = _least_of_windows(laid, s.window)
    # A line is a fingerprint if it is the least of some window that holds it: the greatest of those minima is its own.
    most = ~_least_of_windows(~np.concatenate([np.zeros(s.window - 1, np.uint64), least]), s.window)[: len(laid)]
    chosen = np.flatnonzero((most == laid) & (laid != _NONE))
    text = np.searchsorted(gaps, chosen, side="right") - 1
    return text, chosen - gaps[text], laid[chosen]


def physical_lines(words: np.ndarray, counts: np.ndarray, places: np.ndarray, breaks: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Text, position, number of words and two hashes of every physical line of ``short`` to ``least`` - 1 words.

    ``places`` are the words' bytes in the batch, ``breaks`` those of its line breaks and of the ends of its texts.
    """
    edges = np.unique(np.concatenate([[0], np.searchsorted(places, breaks), [len(words)]]))
    first, last = edges[:-1], edges[1:]
    size = last - first
    some = (size >= s.short) & (size < s.least)
    first, last, size = first[some], last[some], size[some]
    begin = np.cumsum(counts) - counts
    text = np.searchsorted(begin, first, side="right") - 1
    text = np.where(len(begin) > 0, text, 0)
    one, two = (sums_of(x, first, last) for x in (words, mix(words ^ _OTHER)))
    return text, first - begin[text], size, mix(one + size.astype(np.uint64)), mix(two ^ size.astype(np.uint64))


def _again(text: np.ndarray, key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by text, key and position, and the previous position of the same key in the same text (-1 at the first)."""
    order = np.lexsort((pos, *key[::-1], text))
    prev = np.full(len(pos), -1, np.int64)
    same = text[order][1:] == text[order][:-1]
    for k in key:
        same = same & (k[order][1:] == k[order][:-1])
    at = np.flatnonzero(same) + 1
    prev[at] = pos[order][at - 1]
    return order, prev


def _mark(text: Column) -> Column:
    """A checksum that tells texts of one id apart."""
    return (F.crc32(F.encode(text, "UTF-8")) - (1 << 31)).cast("int")


def _ints(x: np.ndarray, kind: type = np.int32) -> pa.Array:
    return pa.array(x.astype(kind))


def _prev(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32), mask=x < 0)


def fingerprints(df: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(fp, check, n, doc, t, pos, prev) of fingerprints (n is null) and physical lines (n words); prev is the previous
    position of the same in its text, null at the first; t tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                docs, texts = np.array(batch.column(0).to_pylist(), np.int64), [t.encode("utf-8") for t in batch.column(1).to_pylist()]
                for a, z in chunks(texts):
                    words, counts, places, breaks = word_hashes(texts[a:z], lines=True)
                    text, pos, fp = winnow(words, counts, s)
                    order, prev = _again(text, np.array([fp]), pos)
                    own, t = docs[a:z], np.array([crc32(x) - (1 << 31) for x in texts[a:z]], np.int32)
                    none = np.zeros(len(order), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fp[order].view(np.int64)), pa.array(none), pa.array(none.astype(np.int32), mask=none == 0), pa.array(own[text[order]]), pa.array(t[text[order]]), _ints(pos[order]), _prev(prev)], names=names
                    )
                    text, pos, size, one, two = physical_lines(words, counts, places, breaks, s)
                    order, prev = _again(text, np.array([one, two]), pos)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one[order].view(np.int64)), pa.array(two[order].view(np.int64)), _ints(size[order]), pa.array(own[text[order]]), pa.array(t[text[order]]), _ints(pos[order]), _prev(prev)], names=names
                    )

    names = ["fp", "check", "n", "doc", "t", "pos", "prev"]
    narrow = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), text_col)
    return narrow.mapInArrow(run, "fp long, check long, n int, doc long, t int, pos int, prev int")


def _with_ids(df: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """Semi or anti join with an id set, broadcast if it is counted small."""
    small = ids.count() <= BROADCAST_IDS
    ids = ids.withColumnRenamed(ids.columns[0], "__id")
    return df.join(F.broadcast(ids) if small else ids, F.col(id_col) == F.col("__id"), how)


def _first_places(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows``, without the key, whose key stands at two places or more, with its first place (source, at) and the number of places."""
    first = F.min_by("pos", F.when(F.col("prev").isNull(), F.col("doc")))  # plain columns, so that no sort is needed to aggregate
    origins = rows.groupBy(*key).agg(F.min("doc").alias("source"), first.alias("at"), F.count("*").alias("places")).where("places > 1")
    return skew_join(rows, materialize(origins, "origins"), key, "places").drop(*key)


def matches(df: DataFrame, placed: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(doc, t, found, within, spots): per text, the sources' words around its matches, the diagonals within the
    text itself, and fingerprints with earlier places that weren't tried."""
    prints = placed.where("n is null")
    pairs = prints.where("prev is null and source < doc").groupBy("doc", "t", "source", (F.col("pos") - F.col("at")).alias("shift"))
    pairs = materialize(pairs.agg(F.min("pos").alias("low"), (F.max("pos") + s.line).alias("end")), "diagonals")
    sources = materialize(pairs.select("source").distinct(), "sources")
    texts = _with_ids(df.select(F.col(id_col).cast("long").alias("source"), F.col(text_col).alias("text")), sources, "source", "left_semi")
    texts = texts.select("source", words_of(F.col("text")).alias("words"))  # split once, not at every match
    first = F.greatest(F.col("low") - F.col("shift") - s.margin, F.lit(0))
    size = F.col("end") - F.col("shift") + s.margin - first
    cut = pairs.join(texts, "source").select("doc", "t", F.struct("source", (first + F.col("shift")).alias("at"), F.array_join(F.slice("words", first + 1, size), " ").alias("words")).alias("cut"))
    found = cut.groupBy("doc", "t").agg(F.collect_list("cut").alias("found"))
    within = prints.where("prev is not null").groupBy("doc", "t", (F.col("pos") - F.col("prev")).alias("shift")).agg(F.min("pos").alias("low"), (F.max("pos") + s.line).alias("end"))
    within = within.groupBy("doc", "t").agg(F.collect_list(F.struct("shift", "low", "end")).alias("within"))
    spots = prints.where("places > 2").groupBy("doc", "t").agg(F.collect_set("pos").alias("spots"))
    return found.join(within, ["doc", "t"], "full").join(spots, ["doc", "t"], "full")


def equal_runs(own: np.ndarray, other: np.ndarray, at: int, least: int) -> list[tuple[int, int]]:
    """Maximal runs [first, last) of at least ``least`` words of ``own`` equal to ``other`` laid at position ``at``."""
    low, high = max(at, 0), min(at + len(other), len(own))
    if high - low < least:
        return []
    same = np.zeros(high - low + 2, np.int8)
    same[1:-1] = own[low:high] == other[low - at : high - at]
    turn = np.flatnonzero(np.diff(same)) + low
    return [(a, b) for a, b in zip(turn[::2].tolist(), turn[1::2].tolist()) if b - a >= least]


def repeated_runs(doc: int, own: np.ndarray, found: list[tuple[int, int, np.ndarray]], within: list[dict], s: Settings) -> list[tuple[int, int, int]]:
    """Runs (first, last, source) of ``own`` that the sources' words (source, at, words) or the text itself hold before."""
    hits = [(a, b, source) for source, at, words in found for a, b in equal_runs(own, words, at, s.least)]
    for d in within:
        low, high = max(d["low"] - s.margin, d["shift"]), min(d["end"] + s.margin, len(own))
        hits += [(a + low, b + low, doc) for a, b in equal_runs(own[low:high], own[low - d["shift"] : high - d["shift"]], 0, s.least)]
    return sorted(set(hits))


def untried(n: int, spots: list[int], runs: list[tuple[int, int, int]], s: Settings) -> np.ndarray:
    """Positions of the runs of ``least`` words that hold the line at a spot and don't lie in a run that is found."""
    wanted = np.zeros(max(n - s.least + 1, 0) + 1, np.int32)
    spot = np.array(spots)
    low, high = np.maximum(spot - (s.least - s.line), 0), np.minimum(spot, len(wanted) - 2) + 1
    some = low < high
    np.add.at(wanted, low[some], 1)
    np.add.at(wanted, high[some], -1)
    wanted = np.cumsum(wanted[:-1]) > 0
    for a, b, _ in runs:
        wanted[a : b - s.least + 1] = False
    return np.flatnonzero(wanted)


_RUN = "struct<first:int,last:int,source:bigint>"
_RUN_TYPE = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("source", pa.int64())])


def _run_rows(runs: list[tuple[int, int, int]]) -> pa.StructArray:
    first, last, source = zip(*runs) if runs else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(source, pa.int64())], fields=list(_RUN_TYPE))


def verified(rows: DataFrame, s: Settings) -> DataFrame:
    """Of rows (doc, t, text, found, within, spots): a row (doc, t, run) for each repeated run, and a row (doc, t, gram,
    check, pos, prev) for each run of ``least`` words that is still to be looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                docs, t, texts, found, within, spots = (c.to_pylist() for c in whole.slice(at, 256).columns)
                raw = [x.encode("utf-8") for x in texts]
                for a, z in chunks(raw):
                    yield from check(docs[a:z], t[a:z], raw[a:z], found[a:z], within[a:z], spots[a:z])

    def check(docs: list, t: list, raw: list[bytes], found: list, within: list, spots: list) -> Iterator[pa.RecordBatch]:
        cuts = [(i, f["source"], f["at"], f["words"].encode("utf-8")) for i, own in enumerate(found) for f in own or ()]
        sent: list[list[tuple]] = [[] for _ in raw]
        for c, d in chunks([x[3] for x in cuts]):
            hashed, sizes = word_hashes([x[3] for x in cuts[c:d]])
            for (i, source, place, _), other in zip(cuts[c:d], np.split(hashed, np.cumsum(sizes)[:-1])):
                sent[i].append((source, place, other))
        words, counts = word_hashes(raw)
        begin, hits, owner, text, pos = np.cumsum(counts) - counts, [], [], [], []
        for i, doc in enumerate(docs):
            own = words[begin[i] : begin[i] + counts[i]]
            runs = repeated_runs(doc, own, sent[i], within[i] or (), s)
            hits += runs
            owner += [i] * len(runs)
            if spots[i]:
                pos.append(untried(len(own), spots[i], runs, s))
                text.append(np.full(len(pos[-1]), i))
        ids, marks = np.array(docs, np.int64), np.array(t, np.int32)
        blank, of = pa.nulls(len(hits), pa.int64()), np.array(owner, int)
        yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(marks[of]), _run_rows(hits), blank, blank, blank.cast(pa.int32()), blank.cast(pa.int32())], names=names)
        if text:
            of, pos = np.concatenate(text), np.concatenate(pos)
            first = begin[of] + pos
            gram, other = (mix(sums_of(x, first, first + s.least)) for x in (words, mix(words ^ _OTHER)))
            order, prev = _again(of, np.array([gram, other]), pos)
            of = of[order]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[of]), pa.array(marks[of]), pa.nulls(len(of), _RUN_TYPE), pa.array(gram[order].view(np.int64)), pa.array(other[order].view(np.int64)), _ints(pos[order]), _prev(prev)], names=names
            )

    names = ["doc", "t", "run", "gram", "check", "pos", "prev"]
    return rows.mapInArrow(run, f"doc long, t int, run {_RUN}, gram long, check long, pos int, prev int")


def _later(placed: DataFrame, size: Column) -> DataFrame:
    """(doc, t, run) of the rows, of so many words each, that have an earlier place."""
    run = F.struct(F.col("pos").alias("first"), (F.col("pos") + size).cast("int").alias("last"), "source")
    return placed.where("prev is not null or source < doc").select("doc", "t", run.alias("run"))


def all_runs(df: DataFrame, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, t, runs): the runs (first, last, source), in words, that go from each text that repeats something."""
    prints = materialize(fingerprints(df, s, id_col, text_col), "fingerprints")
    placed = materialize(_first_places(prints, ["fp", "check"]), "placed")
    found = materialize(matches(df, placed, s, id_col, text_col), "matches")
    texts = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), _mark(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    texts = _with_ids(texts, found.select("doc").distinct(), "doc", "left_semi").drop("__id").join(found, ["doc", "t"])
    checked = materialize(verified(texts.select("doc", "t", "text", "found", "within", "spots"), s), "runs")
    grams = checked.where("run is null").select("doc", "t", "gram", "check", "pos", "prev")
    rest = _later(_first_places(grams, ["gram", "check"]), F.lit(s.least)).union(_later(placed.where("n is not null"), F.col("n")))
    return checked.where("run is not null").select("doc", "t", "run").union(rest).groupBy("doc", "t").agg(F.array_sort(F.collect_set("run")).alias("runs"))


def merged(runs: list[dict], n: int) -> list[tuple[int, int, int]]:
    """Runs of one source that overlap or touch become one; none reaches beyond the text's ``n`` words."""
    out: list[list[int]] = []
    open_: dict[int, list[int]] = {}
    for r in runs:
        last = open_.get(r["source"])
        if r["last"] > n:
            continue
        if last is not None and r["first"] <= last[1]:
            last[1] = max(last[1], r["last"])
        else:
            open_[r["source"]] = last = [r["first"], r["last"], r["source"]]
            out.append(last)
    return sorted(map(tuple, out))


def spans_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each word, in code points."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    turn = np.flatnonzero(blank[1:] != blank[:-1])
    return turn[::2], turn[1::2]


def without(text: str, starts: np.ndarray, ends: np.ndarray, runs: list[tuple[int, int, int]]) -> str:
    """The text without the runs' words; a gap keeps its line break."""
    n = len(starts)
    gone = np.zeros(n, np.int8)
    for a, b, _ in runs:
        gone[a:b] = 1
    edge = np.flatnonzero(np.diff(gone, prepend=0, append=0))
    out, at = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        before = int(ends[a - 1]) if a else 0
        after = int(starts[b]) if b < n else len(text)
        gap = text[before : starts[a]] + text[ends[b - 1] : after]
        out += [text[at:before] if a else "", ("\n" if "\n" in gap else " ") if a and b < n else ""]
        at = after
    return "".join(out) + text[at:]


def dedup_lines(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row and column of ``df``, the text without its repeated runs, and ``removed_runs``:
    (start, end, source) in code points of the text as given, and the id that keeps the run."""
    s = settings
    df = df.drop("removed_runs")
    found = materialize(all_runs(df, s, id_col, text_col), "all-runs")
    kind = "array<struct<start:int,end:int,source:bigint>>"
    schema = T.StructType([*df.schema.fields, T.StructField("removed_runs", T._parse_datatype_string(kind))])
    at_text = df.columns.index(text_col)
    runs_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts, removed = [], []
                for text, own in zip(batch.column(at_text).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                    starts, ends = spans_of(text or "")
                    runs = merged(own or [], len(starts))
                    texts.append(without(text, starts, ends, runs) if runs else text)
                    removed.append([{"start": int(starts[a]), "end": int(ends[b - 1]), "source": d} for a, b, d in runs])
                columns = list(batch.columns[:-1])
                columns[at_text] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, runs_type)], names=schema.names)

    ids = materialize(found.select("doc").distinct(), "ids")
    own = found.select(F.col("doc").alias("__doc"), F.col("t").alias("__t"), F.col("runs").alias("__runs"))
    touched = _with_ids(df, ids, id_col, "left_semi")
    touched = touched.join(own, (F.col(id_col) == F.col("__doc")) & (_mark(F.col(text_col)) == F.col("__t")), "left")
    changed = touched.select(*df.columns, "__runs").mapInArrow(run, schema)
    same = _with_ids(df, ids, id_col, "left_anti").withColumn("removed_runs", F.array().cast(kind))
    return same.unionByName(changed)
