"""Near duplicates by MinHash banding with sequential Bayesian verification.

1. Texts with equal shingle sets (by a 128-bit digest) form classes; only each
   class's smallest id goes on, so copies cost one row.
2. Signatures are cut into bands; equal bands put documents into buckets. In
   every bucket all members are paired with at most ``PIVOTS`` of them only, the
   smallest ids of as many hash classes: never all pairs.
3. Candidates are verified sequentially: batches of signature values are
   compared, and a pair is dropped as soon as the posterior probability that
   its similarity reaches the threshold falls below ``miss``. Survivors are
   confirmed on their full shingle sets by integer arithmetic.
4. Buckets whose members are still in different components get the rest of
   their comparisons: members are dealt into chunks, and pairs of chunks are
   compared in the same batches inside a task, only pairs across components,
   each in the first bucket it shares. Signatures alone move for that, and only members
   with a surviving pair are named. Their texts are then joined, and survivors confirmed inside a task
   by falling agreement; they join their components at once, so only links that
   join something leave the task. No link between components is lost to step
   2, and no pairs of a group are ever written. A chunk has at most ``MEMBERS`` members and
   about ``CHUNK_BYTES`` of text.
5. Components of all confirmed links, by rounds of joins.

Two documents at the threshold share no band with a chance below 1e-6 for the
defaults (0.85: 25 bands of 5); at 0.8 and 32 bands it is 4e-6.

Edge cases: null and empty texts, and texts without words, have no shingles and
no links; with fewer words than a shingle takes, all words are one shingle;
rows that share an id are one document, linked if any of its texts is, and come
back as often as given; null ids are linked with nothing; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstream.llm.components import components
from glyphstream.llm.hashing import chunks, shingle_sets
from glyphstream.runtime import broadcast_if_small, materialize, skew_join

#: Bytes of text that the members of a chunk have together, about.
CHUNK_BYTES = 64 << 20
#: Signature values compared at a time, members of a chunk in step 4, pivots of a bucket.
BATCH, MEMBERS, PIVOTS = 25, 2048, 4


@dataclass(frozen=True)
class Settings:
    """``threshold`` in hundredths: link if 100 * |intersection| >= threshold * |union|."""

    words: int = 5
    threshold: int = 80
    bands: int = 32
    rows: int = 5
    miss: float = 1e-6
    seed: int = 1

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def permutations(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return (rng.integers(0, 1 << 64, (2, self.size), np.uint64) | np.uint64(1)).view(np.uint64)

    def least_matches(self) -> list[tuple[int, int]]:
        """(values compared, matches below which a pair is dropped).

        From a uniform prior, m of n matches leave Beta(m + 1, n - m + 1), whose
        tail above t is the chance of at most m successes in n + 1 trials of t.
        """
        t = self.threshold / 100

        def tail(m: int, n: int) -> float:
            return sum(comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))

        return [(n, next(m for m in range(n + 1) if tail(m, n) >= self.miss)) for n in [*range(BATCH, self.size, BATCH), self.size]]


def _bytes(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8").lower() for t in texts]


def signatures(df: DataFrame, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set, signature (little-endian unsigned 32-bit), and bytes of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = s.permutations()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = _bytes(batch.column(1).to_pylist())
                sizes, digests, signed = [], [], []
                for first, last in chunks(texts):
                    for x in shingle_sets(texts[first:last], s.words):
                        sizes.append(len(x))
                        digests.append(blake2b(x.tobytes(), digest_size=16).digest())
                        least = np.full(s.size, 0xFFFFFFFF, np.uint64)
                        for i in range(0, len(x), 1024):
                            np.minimum(least, ((x[i : i + 1024, None] * a + b) >> np.uint64(32)).min(axis=0), out=least)
                        signed.append(least.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signed, pa.binary()), pa.array(map(len, texts), pa.int64())], names=["doc_id", "n_shingles", "digest", "signature", "bytes"])

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary, bytes long")


def _survive(left: np.ndarray, right: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the rows whose signatures pass every batch, and their matches."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in steps:
        matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive, matches


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, size)


def _close(a: str, b: str, s: Settings):
    """Sizes that let two sets be similar enough."""
    return 100 * F.least(a, b) >= s.threshold * F.greatest(a, b)


def _prune(pairs: DataFrame, signed: DataFrame, s: Settings) -> DataFrame:
    """Step 3's sequential comparison of candidate pairs (a, b)."""
    steps = s.least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive, _ = _survive(_matrix(batch.column(2), s.size), _matrix(batch.column(3), s.size), steps)
            yield batch.select(["a", "b"]).take(pa.array(alive))

    signed = _of(signed, pairs)
    one = signed.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))
    two = signed.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
    joined = pairs.join(two, "b").join(one, "a").where(_close("na", "nb", s))
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def _of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of documents in pairs; the id set is broadcast if counted small, so that wide rows move only if needed."""
    ids = pairs.select(F.col("a").alias("__id")).union(pairs.select("b")).distinct()
    return rows.join(broadcast_if_small(materialize(ids, "ids")), F.col("doc_id") == F.col("__id"), "left_semi")


def _confirm(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Links among the pairs, by the full sets of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                distinct = list(dict.fromkeys(_bytes(batch.column(2).to_pylist() + batch.column(3).to_pylist())))
                sets = {t: x for first, last in chunks(distinct) for t, x in zip(distinct[first:last], shingle_sets(distinct[first:last], s.words))}
                linked = []
                for t, u in zip(_bytes(batch.column(2).to_pylist()), _bytes(batch.column(3).to_pylist())):
                    common = len(np.intersect1d(sets[t], sets[u], assume_unique=True))
                    linked.append(bool(common) and 100 * common >= s.threshold * (len(sets[t]) + len(sets[u]) - common))
                yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    own = materialize(_of(texts, pairs), "candidate-texts")
    one = own.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    two = own.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(two, "b").join(one, "a")
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.count_nonzero(y[at] == x))


def _residual(bands: DataFrame, labels: DataFrame, signed: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Step 4: links (a, b) that join components within a bucket; ``bands`` has band, its number, and doc_id."""
    steps = s.least_matches()
    named = bands.join(labels, bands["doc_id"] == labels["node"], "left").select("band", "number", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    signed = signed.select("doc_id", "n_shingles", "signature", "bytes")
    open_ = named.groupBy("band").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = materialize(open_.where("n > 2 and low < high").select("band", "n"), "open")
    members = materialize(skew_join(named, open_, ["band"], "n").drop("n"), "open-members")
    ids = members.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    own = materialize(_of(signed, ids).drop("__id"), "member-signatures")
    sizes = members.join(own.select("doc_id", "bytes"), "doc_id").groupBy("band").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sizes = sizes.select("band", F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("bytes") / CHUNK_BYTES), F.lit(1)).cast("int").alias("parts"))
    members = skew_join(members, materialize(sizes, "parts"), ["band"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    each = members.select("band", "number", "doc_id", "component", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    each = each.select("band", "number", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "doc_id", "component")
    dealt = each.join(own.drop("bytes"), "doc_id").select("band", "i", "j", "number", "part", "doc_id", "component", "n_shingles", "signature")

    def survivors(rows: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(p, q, matches): each member of chunk i with those of chunk j that it could be linked to, in the first bucket they share."""
        i, j, number = rows[0][1:4]
        part, ids, comp, n = (np.array([r[c] for r in rows], np.int64) for c in (4, 5, 6, 7))
        signs = np.frombuffer(b"".join(r[8] for r in rows), "<u4").reshape(-1, s.size)
        by_band = signs.reshape(len(rows), s.bands, s.rows)
        y = np.flatnonzero(part == j)
        for p in np.flatnonzero(part == i):
            q = y[(100 * np.minimum(n[y], n[p]) >= s.threshold * np.maximum(n[y], n[p])) & (comp[y] != comp[p]) & ((ids[y] > ids[p]) if i == j else True)]
            if not len(q):
                continue
            alive, matches = _survive(np.broadcast_to(signs[p], (len(q), s.size)), signs[q], steps)
            q = q[alive]
            first = (by_band[q] == by_band[p]).all(axis=2).argmax(axis=1) == number
            if first.any():
                yield int(p), q[first], matches[first]

    def named_members(rows: list[tuple]) -> pa.RecordBatch:
        at = sorted({int(r) for p, q, _ in survivors(rows) for r in (p, *q)})
        return pa.RecordBatch.from_arrays([pa.array([rows[r][c] for r in at], k) for c, k in enumerate(kinds)], names=names)

    def confirmed(rows: list[tuple]) -> pa.RecordBatch:
        comp = np.unique([r[6] for r in rows], return_inverse=True)[1]
        root, sets, out = list(range(len(rows))), {}, ([], [])

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        def linked(p: int, q: int) -> bool:
            for r in (p, q):
                if r not in sets:
                    sets[r] = next(shingle_sets(_bytes([rows[r][9]]), s.words))
            x, y = sets[p], sets[q]
            if len(x) != rows[p][7] or len(y) != rows[q][7]:  # another text of a repeated id
                return False
            common = _common(x, y)
            return common > 0 and 100 * common >= s.threshold * (len(x) + len(y) - common)

        for p, q, matches in survivors(rows):
            for r in q[np.argsort(-matches, kind="stable")].tolist():
                if top(comp[p]) != top(comp[r]) and linked(p, r):
                    root[top(comp[r])] = top(comp[p])
                    out[0].append(min(rows[p][5], rows[r][5]))
                    out[1].append(max(rows[p][5], rows[r][5]))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    def by_group(use, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    yield use(held)
                    held = []
                held.append(row)
        if held:
            yield use(held)

    names = ["band", "i", "j", "number", "part", "doc_id", "component", "n_shingles", "signature"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = "band long, i int, j int, number int, part int, doc_id long, component long, n_shingles long, signature binary"
    parts = int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = lambda rows: rows.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j")
    alive = materialize(sent(dealt).mapInArrow(lambda batches: by_group(named_members, batches), schema), "alive")
    ids = alive.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    whole = alive.join(_of(texts, ids).select("doc_id", "text"), "doc_id").select(*names, "text")
    return sent(whole).mapInArrow(lambda batches: by_group(confirmed, batches), "a long, b long").distinct()


def near_duplicates(df: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id``, ``n_shingles``, ``component_id`` (least id reachable) and ``kept``."""
    s = settings
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(df, s, id_col, text_col), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    twins = full.select("doc_id", "digest").join(classes.where("n > 1").select("digest", "rep"), "digest")
    twins = materialize(twins.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), "digest").distinct(), "twins")
    later = broadcast_if_small(twins.select(F.col("b").alias("doc_id"), "digest"))
    firsts = full.join(later, ["doc_id", "digest"], "left_anti")
    if full.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count():  # rows that are repeated
        firsts = firsts.dropDuplicates(["doc_id", "digest"])

    band = lambda i: F.xxhash64(F.substring(F.col("signature"), i * (4 * s.rows) + 1, F.lit(4 * s.rows)), i)
    bands = firsts.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(PIVOTS)).alias("r"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(s.bands - 1)), band)).alias("number", "band"))
    heads = bands.groupBy("band", "r").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    heads = heads.groupBy("band").agg(F.collect_list("pivot").alias("pivots"), F.min("pivot").alias("low"), F.max("most").alias("most"), F.sum("n").alias("n")).where("low < most")
    shared = skew_join(bands, materialize(heads.select("band", "pivots", "n"), "heads"), ["band"], "n")
    shared = materialize(shared.select("band", "number", "doc_id", "pivots"), "buckets")
    pairs = shared.select(F.explode("pivots").alias("p"), "doc_id").where("p <> doc_id")
    pairs = materialize(pairs.select(F.least("p", "doc_id").alias("a"), F.greatest("p", "doc_id").alias("b")).distinct(), "pairs")

    survivors = materialize(_prune(pairs, firsts, s), "survivors")
    links = materialize(_confirm(survivors, texts, s), "links")
    more = _residual(shared.select("band", "number", "doc_id"), components(links), firsts, texts, s)
    links = links.union(materialize(more, "links"))
    labels = components(links.union(twins.select("a", "b")))
    found = signed.select("doc_id", "n_shingles").join(labels, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return found.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, without the later documents of each component.

    Rows that share a kept id all stay, rows without id and without words too; no column name clashes.
    """
    found = near_duplicates(df, settings, id_col, text_col)
    gone = found.where("not kept").select(id_col).distinct()
    return df.join(gone, id_col, "left_anti").select(*df.columns)


#: DuckDB's links and components for the contract's settings (3 words, 85).
SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words
  from documents
), s as (
  select doc_id, unnest(list_distinct(case when len(words) >= 3
    then list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' '))
    when len(words) > 0 then [array_to_string(words, ' ')] else [] end)) as shingle
  from w
), n as (
  select doc_id, count(*) as n from s group by doc_id
), common as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2
), link as (
  select x, y from common join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)
), both_ways as (
  select x, y from link union all select y, x from link
), reach(doc_id, other) as (
  select doc_id, doc_id from w union select r.doc_id, e.y from reach r join both_ways e on r.other = e.x
), least_of as (
  select doc_id, min(other) as component_id from reach group by doc_id
)
select l.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, l.doc_id = component_id as kept
from least_of l left join n on n.doc_id = l.doc_id
"""
