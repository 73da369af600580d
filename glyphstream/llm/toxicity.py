"""Toxic spans by a linear-chain conditional random field over words.

Learning, from labelled documents only:

1. Every labelled text is counted: in how many toxic and clean documents do
   each word, and the words of each prefix, occur? Those with enough evidence are candidates; for those, a
   second pass counts in how many contexts (the words on both sides of their first
   place in a document) they occur on either side, so that words of one copied text don't
   pass for toxic ones. All of them are kept, however many there are.
2. Units that toxic documents use in many contexts, and clean ones hardly, label
   tokens at first: toxic in toxic documents, clean otherwise. (The labels given are of documents.)
3. On a bounded sample of sentences (``SENTENCES``, cut inside the tasks) the chain is fitted by
   gradient ascent on the conditional likelihood. Its features are a word's units, the best evidence
   among them, and that of the words before and after it. Then its own marginals label the
   tokens of the toxic documents' sentences again, so that words the units don't know become toxic by their
   company and known ones clean by theirs, and it is fitted again. On a bounded sample of
   documents (``DOCUMENTS``) a logistic curve maps marginals to document scores; only its four numbers a
   document leave the tasks.

Scoring: forward-backward over every whole text gives each token's marginal;
tokens at 0.5 or more are offending spans, and the expected number of toxic
tokens and the chances of at least one and two make the score. Chains of many texts are
stepped together, in batches of bounded cells.

Only texts are inputs of a score. Edge cases: null and empty texts and texts
without letters have no tokens and get the score of no evidence; very long
texts are one chain; repeated rows score alike; labels given twice for an id
count as toxic if one is; labels without document, null labels and ids are
skipped; extra columns are ignored; without labels of both kinds nothing is
learnt and every score is the same; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphstream.runtime import broadcast_if_small, materialize

_WORD = re.compile(r"[^\W\d_]+")
#: Bounds of what is learnt on the driver: sample documents of each label, sentences.
DOCUMENTS, SENTENCES = 1500, 8_000
#: Letters of a training sentence's word at most: what is beyond can't be known by a prefix.
LETTERS = 64
#: Words of a training sentence, cells (tokens times documents) of a scoring batch, counters held by a task.
SPAN, CELLS, HELD = 40, 400_000, 400_000
#: Prefix lengths; buckets of log odds, the last for tokens without a known unit; words whose scores a task keeps.
PREFIXES, BUCKETS, KNOWN = range(3, 8), 9, 300_000
#: Marginals below this are no evidence: in long texts their sum would grow with the length.
NOISE = 0.05
#: Evidence for a word to label tokens, at least: toxic documents, contexts, contexts for each toxic document
#: (but ENOUGH contexts always do, as distinct contexts become rare in a large corpus), log odds.
LEAST_DOCS, LEAST_CONTEXTS, SPREAD, ENOUGH, LEAST_ODDS = 5, 5, 0.25, 100, 2.5


def lowered(text: str) -> str:
    """Lower case with every code point in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(lowered(text or ""))


def units_of(word: str) -> list[str]:
    """The word and its prefixes of 3 to 7 letters: languages that compound repeat a stem, not a word."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    """Features of a token: its word and prefixes, where known, the bucket of the best log odds
    among them, and the buckets of the words before and after. Weights are scores of toxic minus clean."""

    weights: dict[str, float] = field(default_factory=dict)
    buckets: dict[str, int] = field(default_factory=dict)
    by_bucket: list[float] = field(default_factory=lambda: [0.0] * BUCKETS)
    before: list[float] = field(default_factory=lambda: [0.0] * BUCKETS)
    after: list[float] = field(default_factory=lambda: [0.0] * BUCKETS)
    start: float = 0.0
    #: trans[a][b]: score of state a before state b.
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0, 0.0]))

    def __post_init__(self):
        self.known: dict[str, complex] = {}

    def emissions(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KNOWN:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            own = [u for u in units_of(w) if u in self.weights]
            bucket = max((self.buckets[u] for u in own), default=BUCKETS - 1) if own else BUCKETS - 1
            known[w] = complex(sum(self.weights[u] for u in own) + self.by_bucket[bucket], bucket)
        both = np.fromiter(map(known.__getitem__, words), np.complex128, len(words))
        x, bucket = both.real.copy(), both.imag.astype(np.int8)
        x[1:] += np.array(self.before)[bucket[:-1]]
        x[:-1] += np.array(self.after)[bucket[1:]]
        return x

    def score(self, marginals: np.ndarray) -> float:
        z = float(self.curve @ evidence(marginals))
        return float(1 / (1 + np.exp(-z)))


def evidence(marginals: np.ndarray) -> np.ndarray:
    """Bias, chances of at least one and of at least two toxic tokens, log of one plus their expected number."""
    m = np.minimum(np.where(marginals < NOISE, 0.0, marginals), 1 - 1e-9)
    none = np.exp(np.log1p(-m).sum())
    one = none * (m / (1 - m)).sum()
    return np.array([1.0, 1 - none, max(0.0, 1 - none - one), np.log1p(m.sum())])


def forward_backward(x: np.ndarray, lengths: np.ndarray, start: float, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state, (steps, chains), and expected transitions (2, 2).

    x: emission scores (steps, chains). Both passes work on odds of the two
    states, the backward one on each chain's own length.
    """
    e = np.exp(trans)
    odds = np.exp(np.clip(x, -60, 60))
    ahead, behind = _passes(odds, lengths, start, e)
    both = ahead * behind
    pairs = np.zeros((2, 2))
    if len(x) > 1:
        mask = np.arange(1, len(x))[:, None] < lengths
        a, b = ahead[:-1], odds[1:] * behind[1:]
        weight = np.stack([np.broadcast_to(e[0, 0], a.shape), e[0, 1] * b, e[1, 0] * a, e[1, 1] * a * b])
        pairs = (weight / weight.sum(axis=0) * mask).sum(axis=(1, 2)).reshape(2, 2)
    return both / (1 + both), pairs


def _passes(odds: np.ndarray, lengths: np.ndarray, start: float, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds of toxic given all up to each place, and those of what follows it."""
    ahead, behind = np.empty_like(odds), np.ones_like(odds)
    ahead[0] = np.exp(start) * odds[0]
    for i in range(1, len(odds)):
        o = ahead[i - 1]
        ahead[i] = (e[0, 1] + o * e[1, 1]) / (e[0, 0] + o * e[1, 0]) * odds[i]
    for i in range(len(odds) - 2, -1, -1):
        o = behind[i + 1] * odds[i + 1]
        behind[i] = np.where(i + 1 < lengths, (e[1, 0] + o * e[1, 1]) / (e[0, 0] + o * e[0, 1]), 1.0)
    return ahead, behind


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    x = np.zeros((lengths.max(initial=1), len(rows)))
    for i, r in enumerate(rows):
        x[: len(r), i] = r
    return x, lengths


def marginals_of(model: Model, texts: list[list[str]]) -> list[np.ndarray]:
    """Each text's marginals; texts of like length are stepped together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(texts)
    order = [i for i in sorted(range(len(texts)), key=lambda i: len(texts[i])) if texts[i]]
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(texts[order[end]]) <= CELLS:
            end += 1
        own = order[at:end]
        x, lengths = _padded([model.emissions(texts[i]) for i in own])
        marginals = _marginals(x, lengths, model)
        for j, i in enumerate(own):
            out[i] = marginals[: lengths[j], j]
        at = end
    return out


def _marginals(x: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """As forward_backward, without the transitions."""
    ahead, behind = _passes(np.exp(np.clip(x, -60, 60)), lengths, model.start, np.exp(model.trans))
    both = ahead * behind
    return both / (1 + both)


def _counted(labelled: DataFrame) -> DataFrame:
    """(word, toxic, clean): over all labelled rows, documents with the word, and for a prefix the sum over
    its words; tasks combine before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter] = [Counter(), Counter()]

        def out() -> pa.RecordBatch:
            words = list(held[0] | held[1])
            made = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (held[1], held[0]))], names=["word", "toxic", "clean"]
            )
            held[0].clear(), held[1].clear()
            return made

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[toxic].update(set(words_of(text)))
                if len(held[0]) + len(held[1]) > HELD:
                    yield out()
        yield out()

    each = labelled.select("text", "toxic").mapInArrow(run, "word string, toxic long, clean long")
    words = each.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    starts = [F.when(F.length("word") > n, F.concat(F.left("word", F.lit(n)), F.lit("*"))) for n in PREFIXES]
    units = words.select(F.explode(F.array("word", *starts)).alias("word"), "toxic", "clean").where("word is not null")
    return units.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _contexts(labelled: DataFrame, candidates: list[str]) -> DataFrame:
    """(word, toxic, clean): distinct neighbour words, before and after, of each candidate's first place in a document."""
    shared = labelled.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        of_word: dict[str, list[str]] = {}
        for batch in batches:
            found = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, first = words_of(text), {}
                for i, w in enumerate(words):
                    if w not in of_word:
                        of_word[w] = [u for u in units_of(w) if u in known]
                    for u in of_word[w]:
                        if u not in first:
                            first[u] = " ".join((*words[max(i - 1, 0) : i], "_", *words[i + 1 : i + 2]))
                found.update((u, b, toxic) for u, b in first.items())
                if len(of_word) > KNOWN:
                    of_word = {}
            rows = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int32())], names=["word", "before", "toxic"])

    each = labelled.select("text", "toxic").mapInArrow(run, "word string, before string, toxic int").distinct()
    return each.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"))


def learn(labelled: DataFrame) -> Model:
    """A model from (doc_id, text, toxic 0/1) rows."""
    sizes = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(curve=np.array([0.0 if not n_toxic + n_clean else 4.0 if n_toxic else -4.0, 0.0, 0.0, 0.0]))
    odds = lambda t, c, nt, nc: F.log(((t + 0.5) / nt) / ((c + 0.5) / nc))
    counted = _counted(labelled).where(F.col("toxic") >= LEAST_DOCS)
    rated = materialize(counted.where(odds(F.col("toxic"), F.col("clean"), n_toxic + 1, n_clean + 1) > 1).select("word", F.col("toxic").alias("docs")), "candidates")
    contexts = _contexts(labelled, rated.select("word").toArrow().column(0).to_pylist())
    by_context = odds(F.coalesce("toxic", F.lit(0)), F.coalesce("clean", F.lit(0)), n_toxic, n_clean)
    found = rated.join(contexts, "word", "left").select("word", "docs", F.coalesce("toxic", F.lit(0)).alias("contexts"), by_context.alias("odds"))
    spread = F.col("contexts") >= F.greatest(F.lit(LEAST_CONTEXTS), F.least(SPREAD * F.col("docs"), F.lit(ENOUGH)))
    found = found.select("word", "odds", ((F.col("odds") >= LEAST_ODDS) & spread).alias("labels")).toArrow().to_pydict()  # every unit with evidence
    odds_of = dict(zip(found["word"], found["odds"]))
    toxic_units = frozenset(w for w, labels in zip(found["word"], found["labels"]) if labels)
    del found
    kinds = []
    for kind in (1, 0):
        own = labelled.where(F.col("toxic") == kind)
        ids = own.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(DOCUMENTS)  # ids first: texts of the sample alone move
        kinds.append(own.join(F.broadcast(ids), "doc_id", "left_semi"))
    sample = materialize(kinds[0].union(kinds[1]), "sample")
    model = fit_chain(_sentences(sample, toxic_units), toxic_units, odds_of)
    fit_curve(model, _evidence(sample, model), {1: n_toxic, 0: n_clean})
    return model


def _sentences(sample: DataFrame, toxic_units: frozenset[str]) -> list[tuple[list[str], int]]:
    """(words, toxic) of at most ``SENTENCES`` sentences of the sample, in the order of a hash: half of them of
    toxic documents with a word of the units. Cut inside the tasks, words to ``LETTERS``."""
    shared = sample.sparkSession.sparkContext.broadcast(toxic_units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = shared.value
        for batch in batches:
            rows = []
            for doc, text, kind in zip(*(c.to_pylist() for c in batch.columns)):
                words = [w[:LETTERS] for w in words_of(text)]
                for at in range(0, len(words), SPAN):
                    span = words[at : at + SPAN]
                    rows.append((doc, at, kind, bool(kind) and any(not units.isdisjoint(units_of(w)) for w in span), " ".join(span)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names=["doc", "at", "kind", "hit", "words"])

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
    spans = materialize(sample.select("doc_id", "text", "toxic").mapInArrow(run, "doc long, at int, kind int, hit boolean, words string"), "sentences")
    some = lambda rows: rows.orderBy(F.xxhash64("doc", "at"), "doc", "at").limit(SENTENCES // 2).select("words", "kind").toArrow().to_pylist()
    return [(r["words"].split(" "), r["kind"]) for hit in (True, False) for r in some(spans.where(F.col("hit") == hit))]


def _evidence(sample: DataFrame, model: Model) -> list[tuple[np.ndarray, int]]:
    """(evidence, toxic) of each sampled document, scored in the tasks."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = np.array([evidence(m) for m in marginals_of(shared.value, [words_of(t) for t in batch.column(0).to_pylist()])])
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in rows.T), batch.column(1)], names=["a", "b", "c", "d", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(run, "a double, b double, c double, d double, toxic int")
    found = sorted((r["toxic"], *(r[c] for c in "abcd")) for r in rows.toArrow().to_pylist())  # the same order in any layout
    return [(np.array(r[1:]), r[0]) for r in found]


def evenly(rows: list, most: int) -> list:
    """At most so many of the rows, from all of their length."""
    return rows if len(rows) <= most else [rows[i * len(rows) // most] for i in range(most)]


def fit_chain(sample: list[tuple[list[str], int]], toxic_units: frozenset[str], odds_of: dict[str, float], rounds: int = 60, again: int = 25, rate: float = 0.3) -> Model:
    """Conditional likelihood of the token labels, with a small quadratic penalty, by Adam: first with the units'
    labels, then with those of the chain itself in toxic documents' sentences (a sentence that would lose all keeps its own)."""
    one: dict[str, str] = {}
    sample = [([one.setdefault(w, w) for w in words], kind) for words, kind in sample]
    distinct = set(one)
    bad = {w for w in distinct if not toxic_units.isdisjoint(units_of(w))}
    hits, plain = [], []
    for words, kind in sample:
        for at in range(0, len(words), SPAN):
            span = words[at : at + SPAN]
            (hits if kind and not bad.isdisjoint(span) else plain).append((span, kind))
    spans = evenly(hits, SENTENCES // 2) + evenly(plain, SENTENCES // 2)
    unit_at = {u: i for i, u in enumerate(sorted(odds_of))}
    buckets = {u: int(min(max(o, 0), BUCKETS - 2)) for u, o in odds_of.items()}
    n = len(unit_at)
    words = sorted({w for span, _ in spans for w in span})
    word_at = {w: i for i, w in enumerate(words)}
    pairs_, bucket_of = [], np.full(len(words) + 1, BUCKETS)  # (word, feature); the last is no word
    for i, w in enumerate(words):
        own = [u for u in units_of(w) if u in unit_at]
        bucket_of[i] = max((buckets[u] for u in own), default=BUCKETS - 1)
        pairs_ += [(i, unit_at[u]) for u in own] + [(i, n + bucket_of[i])]
    of_word, feature = np.array(pairs_, int).reshape(-1, 2).T
    steps, none = max((len(s) for s, _ in spans), default=1), len(words)
    grid, label = np.full((steps, len(spans)), none), np.zeros((steps, len(spans)))
    lengths, kinds = np.array([len(s) for s, _ in spans]), np.array([k for _, k in spans])
    for j, (span, kind) in enumerate(spans):
        grid[: len(span), j] = [word_at[w] for w in span]
        label[: len(span), j] = [kind and w in bad for w in span]
    inside = np.arange(steps)[:, None] < lengths
    near = np.full((2, *grid.shape), BUCKETS)  # buckets of the words before and after
    near[0, 1:], near[1, :-1] = bucket_of[grid[:-1]], bucket_of[grid[1:]]
    size = n + BUCKETS
    ends = size + 2 * (BUCKETS + 1)  # units, own buckets, buckets before and after (and none), start, transitions
    theta = np.zeros(ends + 5)

    def scores() -> tuple[np.ndarray, np.ndarray]:
        x = np.append(np.bincount(of_word, theta[feature], len(words)), 0.0)[grid]
        for side in (0, 1):
            weights = theta[size + side * (BUCKETS + 1) :][: BUCKETS + 1].copy()
            weights[-1] = 0
            x += weights[near[side]]
        return forward_backward(x, lengths, theta[ends], theta[ends + 1 :].reshape(2, 2))

    def fit(label: np.ndarray, rounds: int) -> None:
        a, b, both = label[:-1], label[1:], inside[1:]
        seen = np.array([[((1 - a) * (1 - b) * both).sum(), ((1 - a) * b * both).sum()], [(a * (1 - b) * both).sum(), (a * b * both).sum()]])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for r in range(1, rounds + 1):
            marginals, pairs = scores()
            error = np.where(inside, label - marginals, 0.0)
            by_word = np.bincount(grid.ravel(), error.ravel(), len(words) + 1)
            sides = [np.bincount(near[side].ravel(), error.ravel(), BUCKETS + 1) for side in (0, 1)]
            gradient = np.concatenate([np.bincount(feature, by_word[of_word], size), *sides, [error[0].sum()], (seen - pairs).ravel()])
            gradient = gradient / len(spans) - 1e-5 * theta
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            theta[:] += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)

    fit(label, rounds)
    own = np.where(inside & (kinds == 1), scores()[0] >= 0.5, False).astype(float)
    fit(np.where(own.any(axis=0), own, label), again)
    weights = {u: float(theta[i]) for u, i in unit_at.items()}
    sides = [theta[size + side * (BUCKETS + 1) :][:BUCKETS].tolist() for side in (0, 1)]
    return Model(weights, buckets, theta[n:size].tolist(), *sides, float(theta[ends]), theta[ends + 1 :].reshape(2, 2).copy())


def fit_curve(model: Model, sample: list[tuple[np.ndarray, int]], sizes: dict[int, int]) -> None:
    """Logistic regression of the label on the evidence, weighted to the labels' true sizes.

    Projected Newton steps with a small ridge: weights of evidence are never
    negative, so more evidence never lowers a score, and separable samples end
    at finite weights.
    """
    x = np.array([e for e, _ in sample])
    y = np.array([k for _, k in sample], float)
    drawn = Counter(k for _, k in sample)
    weight = np.array([sizes[k] / drawn[k] for _, k in sample])
    weight /= weight.sum()
    beta, ridge = np.zeros(x.shape[1]), 1e-4 * (np.arange(x.shape[1]) > 0)

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * beta**2).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (weight * (p - y)) + ridge * beta
        free = np.flatnonzero((np.arange(len(beta)) == 0) | (beta > 0) | (slope < 0))
        curvature = (x[:, free].T * (weight * p * (1 - p))) @ x[:, free] + np.diag(ridge[free] + 1e-9)
        step, size = np.zeros_like(beta), 1.0
        step[free] = np.linalg.solve(curvature, slope[free])
        bounded = lambda b: np.concatenate([b[:1], np.maximum(b[1:], 0)])
        while size > 1e-8 and loss(bounded(beta - size * step)) > loss(beta):
            size /= 2
        new = bounded(beta - size * step)
        done = np.abs(new - beta).max() < 1e-9
        beta = new
        if done:
            break
    model.curve = beta


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``score`` and ``toxic_spans`` (start, end, marginal) in code points of every whole text."""
    narrow = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = T._parse_datatype_string("array<struct<start:int,end:int,marginal:double>>")
    schema = T.StructType([narrow.schema[0], T.StructField("score", T.DoubleType()), T.StructField("toxic_spans", kind)])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = batch.column(1).to_pylist()
                scores, spans = [], []
                for text, marginals in zip(texts, marginals_of(own, [words_of(t) for t in texts])):
                    scores.append(own.score(marginals))
                    hits = np.flatnonzero(marginals >= 0.5)
                    places = [m.span() for m in _WORD.finditer(lowered(text))] if len(hits) else []
                    spans.append([{"start": places[i][0], "end": places[i][1], "marginal": float(marginals[i])} for i in hits])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, spans_type)], names=schema.names)

    return narrow.mapInArrow(run, schema)


def drop_toxic(df: DataFrame, model: Model, limit: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose texts score below ``limit``; one pass, no join."""
    at_text = df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                found = marginals_of(own, [words_of(t) for t in batch.column(at_text).to_pylist()])
                yield batch.filter(pa.array([own.score(m) < limit for m in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learn_from(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from the documents that ``labels`` (doc_id, toxic) names and that aren't held out."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    marks = marks.withColumnRenamed("doc_id", "__id")
    named = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(broadcast_if_small(marks), F.col("doc_id") == F.col("__id"))
    return learn(materialize(named.select("doc_id", "text", "toxic"), "labelled"))
