"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text are shares and means of its bytes, words and lines. The trees are grown level by level on a sample of labelled
documents, whose statistics are binned at quantiles: each level is one histogram of gradients over node, statistic and
bin. A grown forest is three arrays (statistic, threshold, leaf), so that a batch of documents goes down all trees at once.

Only the sample is bounded (``SAMPLE`` rows a label, by a hash of the id, weighted back to the counts of all labelled rows);
every document is scored, by its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of each label that the trees are grown on at most.
SAMPLE = 10_000

_SPACE = [9, 10, 11, 12, 13, 32]
_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "wide": range(128, 256), "space": _SPACE, "line": [10],
    "stop": b".,;:?", "loud": b"!", "bar": b"|", "mark": b"#*$%&<>@^~", "quote": b"\"'()[]{}", "join": b"-_/\\+=",
}
#: A byte's group; bytes of none are the last.
_OF = np.full(256, len(_GROUPS), dtype="int64")
for _i, _bytes in enumerate(_GROUPS.values()):
    _OF[list(_bytes)] = _i
_OF[10] = list(_GROUPS).index("line")
_N = len(_GROUPS) + 1

NAMES = [
    "bytes", "words", "lines", *(f"share_{g}" for g in (*_GROUPS, "other")), *(f"ends_{g}" for g in (*_GROUPS, "other")), *(f"begins_{g}" for g in (*_GROUPS, "other")),
    "byte_entropy", "word_mean", "word_deviation", "word_longest", "word_short", "distinct_words", "distinct_pairs", "distinct_lines", "words_a_line", "line_longest", "top_word",
]


def statistics(text: str | None) -> np.ndarray:
    """The statistics ``NAMES`` of one whole text; all zero without a word."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype="uint8")
    inside = np.concatenate([[False], ~np.isin(raw, _SPACE), [False]])
    begins, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:])
    n = len(begins)
    if not n:
        return np.zeros(len(NAMES))
    seen = np.bincount(raw, minlength=256)
    share = seen / len(raw)
    sizes = ends - begins + 1
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    ids: dict[str, int] = {}
    order = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype="int64", count=len(words))
    pairs = order[:-1] * len(ids) + order[1:]
    return np.concatenate([
        [np.log1p(len(raw)), np.log1p(n), np.log1p(len(lines))],
        np.bincount(_OF, weights=share, minlength=_N),
        np.bincount(_OF[raw[ends]], minlength=_N) / n,
        np.bincount(_OF[raw[begins]], minlength=_N) / n,
        [
            -(share[share > 0] * np.log2(share[share > 0])).sum(), sizes.mean(), sizes.std(), np.log1p(sizes.max()), (sizes <= 2).mean(),
            len(ids) / len(words), len(np.unique(pairs)) / max(len(pairs), 1), len(set(lines)) / len(lines), np.log1p(n / len(lines)),
            np.log1p(max(map(len, lines))), np.bincount(order).max() / len(words),
        ],
    ])


@dataclass(frozen=True)
class Settings:
    """How the trees are grown."""

    trees: int = 120
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    ridge: float = 2.0
    least: float = 5.0  # summed second derivatives that a side of a split has at least


@dataclass(frozen=True)
class Forest:
    """Full binary trees of one depth as arrays: a row a tree, nodes in level order. A node that isn't split sends all to the left."""

    base: float
    statistic: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The summed leaves of each row of ``x``, all trees at once."""
        n_trees, inner = self.statistic.shape
        at, tree, row = np.zeros((len(x), n_trees), dtype="int64"), np.arange(n_trees)[None, :], np.arange(len(x))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            right = x[row, self.statistic[tree, at]] > self.threshold[tree, at]
            at = 2 * at + 1 + right
        return self.base + self.leaf[tree, at - inner].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, settings: Settings = Settings()) -> Forest:
    """Trees for the log loss of ``y`` (0 or 1). Without rows, or with one label only, the forest is its base alone, half-way smoothed."""
    inner, n_leaves = 2**settings.depth - 1, 2**settings.depth
    good = float((weight * y).sum())
    base = float(np.log((good + 1) / (weight.sum() - good + 1)))
    if not len(x) or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), dtype="int64"), np.zeros((0, inner)), np.zeros((0, n_leaves)))
    weight = weight / weight.mean()
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, settings.bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)  # x <= cuts[b] for bins up to b
    wide, n_stats = settings.bins, x.shape[1]
    cell = binned + np.arange(n_stats) * wide
    margin = np.full(len(x), base)
    found = Forest(base, np.zeros((settings.trees, inner), dtype="int64"), np.full((settings.trees, inner), np.inf), np.zeros((settings.trees, n_leaves)))
    for t in range(settings.trees):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = weight * (p - y), weight * p * (1 - p)
        at = np.zeros(len(x), dtype="int64")
        for level in range(settings.depth):
            first, n_nodes = 2**level - 1, 2**level
            place = ((at - first)[:, None] * (n_stats * wide) + cell).ravel()
            g, h = (np.bincount(place, np.repeat(v, n_stats), n_nodes * n_stats * wide).reshape(n_nodes, n_stats, wide) for v in (slope, bend))
            left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + settings.ridge) + right_g**2 / (right_h + settings.ridge) - all_g**2 / (all_h + settings.ridge)
            gain = np.where((left_h >= settings.least) & (right_h >= settings.least), gain, 0.0).reshape(n_nodes, -1)
            best = gain.argmax(axis=1)
            for node in np.flatnonzero(gain.max(axis=1) > 1e-9):
                s, b = divmod(int(best[node]), wide)
                found.statistic[t, first + node], found.threshold[t, first + node] = s, cuts[s][b]
            at = 2 * at + 1 + (x[np.arange(len(x)), found.statistic[t, at]] > found.threshold[t, at])
        leaf = at - inner
        found.leaf[t] = -settings.rate * np.bincount(leaf, slope, n_leaves) / (np.bincount(leaf, bend, n_leaves) + settings.ridge)
        margin = margin + found.leaf[t][leaf]
    return found


def held_out(doc: str = "doc_id", of: int = 5) -> Column:
    """Whether crc32 of the id as text is divided by ``of``; a row without id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc).cast("string")) % of == 0, F.lit(False))


def _measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"good": frame["good"], "statistics": [statistics(t) for t in frame["text"]]})


def learn_from(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, settings: Settings = Settings()) -> Forest:
    """The forest of labelled documents (``labels``: ``doc_id``, ``quality`` 0 or 1) that aren't held out.

    At most ``sample`` ids a label, those of the least hashes, weighted by the label's count over all rows. Null labels and ids don't take part; of
    several labels of one id the highest holds; labels without document are counted, not learnt; all rows of a sampled id are learnt.
    """
    told = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("good"))
    counts = {r["good"]: r["n"] for r in told.groupBy("good").agg(F.count("*").alias("n")).collect()}
    picked = [told.where(F.col("good") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for g in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # two samples at most
    rows = docs.select("doc_id", "text").join(ids, "doc_id").select("good", "text").mapInPandas(_measured, "good int, statistics array<double>")
    seen = rows.toPandas()
    x = np.stack(seen["statistics"].to_list()) if len(seen) else np.zeros((0, len(NAMES)))
    y = seen["good"].to_numpy(dtype="float64")
    weight = np.array([counts[g] / max((y == g).sum(), 1) for g in seen["good"]], dtype="float64")
    order = np.lexsort((y, *x.T))  # sums don't depend on the order in which tasks end
    return grow(x[order], y[order], weight[order], settings)


def score(docs: DataFrame, forest: Forest, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc``, ``score``): every row's probability of label 1, from its whole text alone.

    Null and empty texts, and texts without words, have the score of statistics that are all zero; rows without id and repeated rows are
    scored each; other columns are dropped; no rows give no rows.
    """
    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.stack([statistics(t) for t in frame["text"]]) if len(frame) else np.zeros((0, len(NAMES)))
            yield pd.DataFrame({doc: frame[doc], "score": forest.scores(x)})

    rows = docs.select(F.col(doc), F.col(text).alias("text"))
    return rows.mapInPandas(scored, f"`{doc}` {docs.schema[doc].dataType.simpleString()}, score double")
