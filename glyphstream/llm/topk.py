"""Exact top-k by inner product, pruned by multi-resolution segment statistics.

Vectors become integers, floor(scale * x). Each is summarised at several
resolutions, coarse to fine: 1, 4, 16 and 32 segments, each by its mean and deviation. With segment
length L, Cauchy-Schwarz gives q.x <= sum of L * (mean_q mean_x + dev_q dev_x),
which bounds the distance |q|^2 + |x|^2 - 2 q.x from below. A block's candidates are taken in the order of their
coarse bound, the most promising first, in tiles; a tile's pairs go as soon as a bound can't reach the query's k-th
best so far, and the exact products are made for the queries and candidates of a tile that have
pairs left. Ties at the k-th score survive, so results
are exact with ties to the smaller id. ``search_block`` reports how many pairs each resolution left.

The stated queries are searched against all vectors in blocks: vectors and
queries are dealt into blocks bounded in rows and bytes, each pair of blocks is one group
of rows that a task streams, and only k rows a query and block leave it. A copied vector that is a third of all
rows is dealt by its rows' ids, so it fills no block.

Edge cases: vectors that are null or empty or hold null or non-finite values, and rows
without id, take no part; vectors of unequal lengths are not compared; a query
id given more than once is searched once, by its least vector; repeated
candidate rows each count; rows with the query's id are its own and left out;
with fewer candidates than k all are returned; extra columns are ignored; very long vectors make
blocks of fewer rows; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.runtime import materialize

RESOLUTIONS = (1, 4, 16, 32)
#: Rows of a block: candidates at least and at most, queries at most; numbers that a block's vectors hold at most.
LEAST, MOST, QUERIES, NUMBERS = 4096, 65536, 8192, 1 << 23
#: Queries and candidates of a tile; the resolution that orders candidates, and how many times k of them a query tries first.
TILE, STEP, SEED, SEEDS = 128, 512, 1, 2


def integers(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v) of the vectors that take part, components as floor(scale * x)."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: F.coalesce(sound(x), F.lit(False)))
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    return df.where(usable).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def summaries(x: np.ndarray) -> list[np.ndarray]:
    """Per resolution, (means, deviations) scaled by the root of the segment length, so that
    the bound is a plain product of two summaries."""
    found = []
    for n in RESOLUTIONS:
        parts = np.array_split(x, min(n, x.shape[1]), axis=1)
        roots = np.sqrt([p.shape[1] for p in parts])
        mean = np.stack([p.mean(axis=1) for p in parts], axis=1) * roots
        dev = np.stack([p.std(axis=1) for p in parts], axis=1) * roots
        found.append(np.concatenate([mean, dev], axis=1))
    return found


def exact_in_floats(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether every partial sum of a product is an exact float."""
    return bool(np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1) < 2**53)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products of all rows of ``q`` with all of ``x``."""
    if exact_in_floats(q, x):
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return (whole(q) @ whole(x).T).astype(np.int64) if q.size and x.size else np.zeros((len(q), len(x)), np.int64)


def best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of each row's k highest scores, ties to smaller ids, in order."""
    order = np.lexsort((ids, -scores, rows))
    sorted_rows = rows[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows)
    return order[rank < k]


def search_block(
    q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int, left: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best in the block; ``left`` counts the pairs, and those each resolution leaves."""
    left = np.zeros(len(RESOLUTIONS) + 1, np.int64) if left is None else left
    parts = [_search_tile(at, q_ids, q, x_ids, x, k, left) for at in range(0, len(q), TILE)]
    return tuple(np.concatenate(p) for p in zip(*parts)) if parts else tuple(np.zeros(0, np.int64) for _ in range(3))


def _search_tile(at: int, q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int, left: np.ndarray) -> tuple[np.ndarray, ...]:
    """As search_block, for the queries from ``at`` on."""
    own_ids, own = q_ids[at : at + TILE], q[at : at + TILE]
    rows, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
    limit = np.full(len(own), -np.inf)
    known, theirs = summaries(own), summaries(x)
    coarse = known[SEED] @ theirs[SEED].T
    order = np.argsort(-coarse.max(axis=0), kind="stable")  # by the best coarse bound of the tile
    most = min(SEEDS * k, len(x))
    seeds = np.zeros(len(x), bool)  # each query's most promising candidates come first and set its limit
    seeds[np.argpartition(-coarse, most - 1, axis=1)[:, :most]] = True
    order = np.concatenate([order[seeds[order]], order[~seeds[order]]])
    for first, last in _steps(int(seeds.sum()), len(order)):
        some = order[first:last]
        alive = own_ids[:, None] != x_ids[some][None, :]
        left[0] += alive.sum()
        for i, (a, b) in enumerate(zip(known, theirs)):
            bound = a @ b[some].T
            alive &= bound + (1e-9 * np.abs(bound) + 1e-6) >= limit[:, None]
            left[i + 1] += alive.sum()
            if not alive.any():
                break
        i, j = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(i):
            continue
        product = exact(own[i], x[some[j]])
        r, c = np.nonzero(alive[np.ix_(i, j)] & (product >= limit[i][:, None]))
        rows, ids, scores = (np.concatenate(p) for p in ((rows, i[r]), (ids, x_ids[some[j[c]]]), (scores, product[r, c])))
        kept = best(rows, ids, scores, k)
        rows, ids, scores = rows[kept], ids[kept], scores[kept]
        full = np.bincount(rows, minlength=len(own)) >= k
        end = np.searchsorted(rows, np.arange(len(own)), side="right") - 1
        limit[full] = scores[end[full]]
    return rows + at, ids, scores


def _steps(seeds: int, n: int) -> list[tuple[int, int]]:
    """[first, last) of the candidates compared at a time."""
    edges = [0, *range(seeds, n, STEP), n]
    return [(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def top_k(
    vectors: DataFrame, is_query: Callable[[Column], Column], k: int, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
    least: int = LEAST, most: int = MOST,
) -> DataFrame:
    """(query_id, rank, id, score): the k highest integer products of each query; ``is_query``
    tells by the id which rows are queries."""
    spark = vectors.sparkSession
    all_ = materialize(integers(vectors, id_col, vector_col, scale).withColumn("dim", F.size("v")), "vectors")
    queries = all_.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n, n_queries, width = all_.count(), queries.count(), all_.agg(F.max("dim")).first()[0] or 1
    blocks = max(1, -(-n // least))
    blocks = max(min(blocks, spark.sparkContext.defaultParallelism), -(-n // min(most, max(1, NUMBERS // width))))
    query_blocks = max(1, -(-n_queries // min(QUERIES, max(1, NUMBERS // width))))
    block = lambda of, m: F.pmod(F.xxhash64(of), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    right = all_.select("dim", block("id", blocks).alias("b"), each(query_blocks).alias("qb"), F.lit(1).alias("side"), "id", "v")
    left = queries.select("dim", each(blocks).alias("b"), block("id", query_blocks).alias("qb"), F.lit(0).alias("side"), "id", "v")

    def search(side: np.ndarray, ids: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        is_query = side == 0
        if is_query.any() and not is_query.all():
            q_ids = ids[is_query]
            row, found, score = search_block(q_ids, values[is_query], ids[~is_query], values[~is_query], k)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(found), pa.array(score)], names=["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # parts of the group that is being read, as arrays
        group = None
        for batch in batches:
            keys = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]], axis=1)
            turn = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, z in zip(turn, turn[1:]):
                if a == z:
                    continue
                if held and group != tuple(keys[a]):
                    yield from search(*map(np.concatenate, zip(*held)))
                    held = []
                group, part = tuple(keys[a]), batch.slice(a, z - a)
                values = part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(z - a, -1)
                held.append((part.column(3).to_numpy(), part.column(4).to_numpy(), values))
        if held:
            yield from search(*map(np.concatenate, zip(*held)))

    groups = max(blocks * query_blocks, 1)
    dealt = right.unionByName(left).repartition(groups, "dim", "b", "qb").sortWithinPartitions("dim", "b", "qb", "side", "id")
    found = dealt.mapInArrow(run, "query_id long, id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


#: The same rows by DuckDB.
SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
