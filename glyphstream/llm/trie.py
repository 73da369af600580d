"""Prefix trie of conversations by Patricia construction.

Every conversation is a path of turns. Distinct paths are sorted, and only branch points, end points and leaves become
nodes, found from the longest common prefix of neighbours with a stack; the edges between them are compressed. The
aggregates are computed on this compressed tree; a node with one child, which no path ends at, is made when its edge
closes, from suffix sums over the edge.

The sort is one exchange by range, so a frequent first turn is spread over as many tasks as its paths need. Copies of a path are
counted before. A task sees one range of paths and the common prefix of its range with both neighbours: nodes inside
are complete, nodes on a prefix shared with a neighbour (the spine) are parts. Parts are added up by their key; there
are no more of them than ranges times depth. No node is known by more than one row outside the spine.

What a task holds: the digests of one conversation (20 bytes a turn), the stack, and rows that wait for their
parent's smallest member, of one range of paths at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphstream.runtime import materialize, ranked, skew_join

#: Ids of members that are joined into one text before they are hashed.
BLOCK_BITS = 10
NO_ENDS = hashlib.sha256(b"").hexdigest()


def paths(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(``conv_id``, ``turns``): per conversation its turns in order, as array of (a, b, size), a digest of 128 bits and code points.

    Null turns come first; equal turns go by role, then text; null role or text is empty; rows without conversation take no part;
    other columns are dropped; no rows give no rows.
    """
    plain = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    placed = ranked(plain, ["turn", "role", "text"], ["conv_id"], "place")
    said = placed.select("conv_id", F.struct(
        "place", F.xxhash64("role", "text").alias("a"), F.xxhash64("text", "role").alias("b"), F.length("text").alias("size"),
    ).alias("said"))
    whole = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    return whole.select("conv_id", F.transform("said", lambda t: F.struct(t["a"], t["b"], t["size"])).alias("turns"))


def rebuilt(whole: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c begins with the first h turns of c - c % ``group``, then come its own after its first h.

    h is crc32 of c as decimal text, modulo ``most``. Where that other conversation is absent, nothing is taken from it; a
    conversation of which nothing is left has no turns and stays.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    heads = whole.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, most - 1).alias("__head"))
    joined = whole.withColumns({"__base": F.col("conv_id") - F.col("conv_id") % group, "__h": h}).join(heads, "__base", "left")
    own = F.slice("turns", F.col("__h") + 1, F.greatest(F.size("turns") - F.col("__h"), F.lit(0)))
    head = F.when(F.col("__head").isNull(), F.slice("turns", 1, F.lit(0))).otherwise(F.slice("__head", F.lit(1), F.col("__h")))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Turns that two paths share at their beginning; -1 where one is absent."""
    return pd.Series([-1 if x is None or y is None else _shared(x, y) for x, y in zip(a, b)], dtype="int32")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    n = min(len(x), len(y))
    apart = np.flatnonzero(x[:n] != y[:n])
    return int(apart[0] if len(apart) else n) // 2


class _Node:
    """An open node of the compressed tree: its depth, what its closed children hold, and rows that wait for its smallest member."""

    __slots__ = ("depth", "end", "first", "kids", "leaves", "members", "saved", "smallest", "waiting")

    def __init__(self, depth: int, first: bool):
        self.depth, self.first = depth, first
        self.members = self.leaves = self.saved = self.kids = 0
        self.smallest, self.end, self.waiting = None, (None, None), []

    def take(self, members: int, smallest: int) -> None:
        self.members += members
        self.smallest = smallest if self.smallest is None else min(self.smallest, smallest)


class _Range:
    """The paths of one range in order: nodes of the compressed tree, closed as soon as their last path is seen."""

    def __init__(self, part: int, left: int, right: int):
        self.part, self.left, self.right = part, left, right
        self.open, self.out = [_Node(0, True)], []
        self.path, self.sizes, self.keys = None, None, None

    def add(self, path: np.ndarray, sizes: np.ndarray, members: int, smallest: int, end: tuple[int, int]) -> None:
        first = self.path is None
        if not first:
            self._close(_shared(self.path, path), False)
        self.path, self.sizes = path, sizes.tolist()
        turns = np.concatenate([np.zeros((1, 2), dtype="int64"), path.reshape(-1, 2)])
        self.keys = np.bitwise_xor.accumulate(turns, axis=0).tolist()
        if len(self.sizes) > self.open[-1].depth:
            self.open.append(_Node(len(self.sizes), first))
        self.open[-1].take(members, smallest)
        self.open[-1].end = end

    def finish(self) -> None:
        self._close(0, True)
        self._edge(self.open.pop(), None, True)

    def _close(self, depth: int, last: bool) -> None:
        """Close the nodes below ``depth``; where the deepest that stays is above it, a branch point begins there."""
        while self.open[-1].depth > depth:
            node = self.open.pop()
            above = max(self.open[-1].depth, depth)
            if self.open[-1].depth < above:
                self.open.append(_Node(above, node.first))
            self._edge(node, self.open[-1], last)

    def _edge(self, node: _Node, parent: _Node | None, last: bool) -> None:
        """Rows of ``node`` and of the unary nodes between it and ``parent``, by suffix sums over the edge."""
        spine = max(self.left if node.first else -1, self.right if last else -1)  # depths up to here are parts
        top = 0 if parent is None else parent.depth + 1
        if not node.leaves and node.depth > (self.right if last else -1):
            node.leaves = 1
        kids, saved = node.kids, node.saved
        row: tuple | None = None
        for depth in range(node.depth, top - 1, -1):
            size = self.sizes[depth - 1] if depth else 0
            if depth > spine:
                saved += (node.members - 1) * size
            end = node.end if depth == node.depth else (None, None)
            row = (depth, node.smallest, node.members, kids, node.leaves, saved, size, *self.keys[depth], *end, depth <= spine, last and depth <= self.right, self.part)
            if depth > top:
                inside = depth - 1 > spine  # the node above is whole, and has the same members
                self.out.append((*row, node.smallest if inside else None, *((None, None) if inside else self.keys[depth - 1])))
            kids = 1 if depth > spine else 0
        if node.waiting:
            whole = node.depth > spine
            above = (node.smallest, None, None) if whole else (None, *self.keys[node.depth])
            self.out.extend((*r, *above) for r in node.waiting)
        if parent is None:
            self.out.append((*row, None, None, None))
            return
        parent.waiting.append(row)
        parent.take(node.members, node.smallest)
        parent.leaves += node.leaves
        parent.saved += saved
        parent.kids += kids


_ROW = ("depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, a long, b long, end_a long, end_b long, "
        "spine boolean, right boolean, part int, parent_conv_id long, parent_a long, parent_b long")
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_WHOLE = [c for c in _NAMES if c.startswith(("n_", "parent", "end")) or c.endswith(("_id", "tokens"))]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_NAMES)
    wide = ["end_a", "end_b", "parent_conv_id", "parent_a", "parent_b"]
    for i, name in zip([_NAMES.index(w) for w in wide], wide):  # nulls beside integers of 64 bits
        frame[name] = pd.array([r[i] for r in rows], dtype="Int64")
    return frame


def _built(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now: _Range | None = None
    for frame in frames:
        for r in frame.itertuples(index=False):
            if now is None or now.part != r.part:
                if now is not None:
                    now.finish()
                    yield _frame(now.out)
                now = _Range(r.part, r.left, r.right)
            now.add(r.path, r.sizes, r.members, r.smallest, (r.end_a, r.end_b))
            if len(now.out) >= 20_000:
                yield _frame(now.out)
                now.out = []
    if now is not None:
        now.finish()
        yield _frame(now.out)


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each key's ids, which come in blocks in order; the hash is carried from block to block."""
    key, so_far = None, hashlib.sha256()
    for frame in frames:
        done = []
        for a, b, ids in zip(frame["end_a"], frame["end_b"], frame["ids"]):
            if key == (a, b):
                so_far.update(b",")
            else:
                if key is not None:
                    done.append((*key, so_far.hexdigest()))
                key, so_far = (a, b), hashlib.sha256()
            so_far.update(ids.encode())
        yield pd.DataFrame(done, columns=["end_a", "end_b", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, so_far.hexdigest())], columns=["end_a", "end_b", "ends_sha256"])


def _ends(members: DataFrame, parts: int) -> DataFrame:
    """(``end_a``, ``end_b``, ``ends_sha256``) of the ids of equal paths, ascending.

    Ids are sorted by range and joined in blocks; a hash over many copies is one pass over its blocks, one at a time in memory.
    """
    laid = members.repartitionByRange(parts, "end_a", "end_b", "conv_id").sortWithinPartitions("end_a", "end_b", "conv_id")
    blocks = laid.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)).groupBy("end_a", "end_b", "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids")
    )
    laid = blocks.repartition(parts, "end_a", "end_b").sortWithinPartitions("end_a", "end_b", "block")
    return laid.mapInPandas(_digests, "end_a long, end_b long, ends_sha256 string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """All nodes of the trie of ``sequences`` (``conv_id``, ``turns`` as of :func:`paths`), one row each.

    ``conv_id`` is the smallest member, ``parent_conv_id`` the parent's (null for the root); ``depth``, ``n_convs``, ``n_children``;
    ``n_leaves`` and ``saved_tokens`` (members but one times the size of the last turn, summed) over the node's subtree, itself included;
    ``ends_sha256`` of the ids, ascending and comma-joined, whose path ends here. Equal paths are one; an empty path ends at the root; no sequences
    give no rows, not even a root.
    """
    spark = sequences.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at: list[Column] = [F.flatten(F.transform("turns", lambda t, i: F.array(F.xxhash64(t["a"], t["b"], i), F.xxhash64(t["b"], t["a"], i)))), F.transform("turns", lambda t: t["size"])]
    flat = sequences.select("conv_id", at[0].alias("path"), at[1].alias("sizes"))
    flat = materialize(flat.withColumns({"end_a": F.xxhash64("path", F.lit(1)), "end_b": F.xxhash64("path", F.lit(2))}), "trie-paths")

    distinct = flat.groupBy("end_a", "end_b").agg(
        F.count("*").alias("members"), F.min("conv_id").alias("smallest"), F.first("path").alias("path"), F.first("sizes").alias("sizes")
    )
    laid = distinct.repartitionByRange(parts, "path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id())
    laid = materialize(laid, "trie-sorted")
    shared = F.pandas_udf(_common, "int")
    ranges = laid.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))  # one row a range
    beside = F.expr("lead(low) over (order by part)")
    ranges = ranges.select("part", shared("high", beside).alias("right"))
    ranges = materialize(ranges, "trie-ranges").selectExpr("part", "right", "coalesce(lag(right) over (order by part), -1) as left")
    told = laid.join(F.broadcast(ranges), "part").repartitionByRange(parts, "part").sortWithinPartitions("part", "path")
    nodes = materialize(told.mapInPandas(_built, _ROW), "trie-nodes")

    pieces = nodes.where("spine")
    key = ["a", "b"]
    spine = pieces.groupBy("depth", *key).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("inner"), F.max("size").alias("size"), F.max("end_a").alias("end_a"), F.max("end_b").alias("end_b"),
        F.min(F.when(F.col("right"), F.col("part"))).alias("owner"), F.max("parent_a").alias("parent_a"), F.max("parent_b").alias("parent_b"),
    )
    spine = materialize(spine, "trie-spine")
    # a node's own saving counts once, on the path of its owner, for the node and all above it
    own = (F.col("n_convs") - 1) * F.col("size")
    along = pieces.where("right").select("part", *key).join(spine.select("depth", *key, "owner", own.alias("own")), key)
    along = along.selectExpr("a", "b", "sum(if(owner = part, own, 0)) over (partition by part order by depth desc) as below")
    below = along.groupBy(*key).agg(F.sum("below").alias("below"))
    under = spine.where("parent_a is not null").groupBy(F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count("*").alias("under"))
    spine = spine.join(below, key).join(under, key, "left").withColumns({
        "saved_tokens": F.col("inner") + F.col("below"), "n_children": F.col("n_children") + F.coalesce("under", F.lit(0)), "parent_conv_id": F.lit(None).cast("long"),
    })
    spine = materialize(spine.select("depth", *key, *_WHOLE), "trie-spine-whole")

    whole = nodes.where("not spine").select("depth", *_WHOLE).unionByName(spine.select("depth", *_WHOLE))
    to_find = whole.where("parent_a is not null").drop("parent_conv_id")
    parents = spine.select(F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("__kids"))
    found = skew_join(to_find, parents, ["parent_a", "parent_b"], "__kids").drop("__kids")
    whole = whole.where("parent_a is null").unionByName(found)

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ended = whole.where("end_a is not null").join(_ends(flat.select("end_a", "end_b", "conv_id"), parts), ["end_a", "end_b"])
    rest = whole.where("end_a is null").withColumn("ends_sha256", F.lit(NO_ENDS))
    both = reduce(DataFrame.unionByName, [x.select(*columns, "ends_sha256") for x in (ended, rest)])
    return both.withColumn("depth", F.col("depth").cast("long"))


#: The same rows of the rebuilt ``conversations`` in DuckDB: every prefix is a row, so for small tables only.
SQL = """
with crc_table as (
  select list_transform(range(256), lambda i: list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), told as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place
  from conversations where conv_id is not null
), ids as (
  select conv_id, conv_id - conv_id % 100 as base,
    xor(list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda d: ascii(d)::bigint),
      lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 6 as h
  from (select distinct conv_id from told), crc_table
), turns as (
  select conv_id, role, text, row_number() over (partition by conv_id order by own, place) as depth from (
    select i.conv_id, 0 as own, role, text, place from ids i join told t on t.conv_id = i.base where place <= h
    union all
    select i.conv_id, 1, role, text, place from ids i join told t using (conv_id) where place > h
  )
), prefixes as (
  select conv_id, depth, length(text) as size,
    sha256(string_agg(sha256(role) || sha256(text), '') over (partition by conv_id order by depth)) as k from turns
  union all
  select conv_id, 0, 0, '' from ids
), nodes as (
  select k, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size from prefixes group by k, depth
), linked as (
  select n.k, n.conv_id, n.depth, n.n_convs, n.size, p.k as parent_k
  from nodes n left join prefixes p on p.conv_id = n.conv_id and p.depth = n.depth - 1
), kids as (
  select parent_k as k, count(*) as n_children from linked where parent_k is not null group by 1
), sums as (
  select p.k, sum((n.n_convs - 1) * n.size) as saved_tokens, count(*) filter (c.k is null) as n_leaves
  from nodes n join prefixes p on p.conv_id = n.conv_id and p.depth <= n.depth left join kids c on c.k = n.k group by 1
), ends as (
  select k, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256
  from (select conv_id, arg_max(k, depth) as k from prefixes group by 1) group by 1
)
select n.conv_id, n.depth, m.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::bigint as n_children, s.n_leaves,
  s.saved_tokens::bigint as saved_tokens, coalesce(e.ends_sha256, sha256('')) as ends_sha256
from linked n left join nodes m on m.k = n.parent_k left join kids c on c.k = n.k join sums s on s.k = n.k left join ends e on e.k = n.k
"""
