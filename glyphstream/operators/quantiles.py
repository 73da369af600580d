"""Exact quantiles of all groups at once, in bounded memory.

An order statistic is kept as an open interval of values, the number of rows in it and its place among them. A sketch of bounded size
proposes two values around the place; exact counts below, at and between them say in which part the place lies. A place that falls on one of the two
values is found, else the interval shrinks to some hundredth of its rows. Intervals of at most ``MOST`` rows are sorted. The sketch only
proposes: whatever its error, the counts keep the result exact, and as both values leave the interval, ties end it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphstream.runtime import materialize, skew_join

#: Values of one interval that are sorted in one place at most: 160 KB.
MOST = 20_000
#: Proposals of the sketch over an interval, and its accuracy: ten rows in a proposal's step.
STEPS, ACCURACY = 256, 2560

_ENDS = ["lo", "hi"]


def _key(group: list[str]) -> Column:
    """The group as one value that is never null, so that groups of nulls match too."""
    return F.struct(*map(F.col, group)) if group else F.struct(F.lit(1).alias("all"))


def _within(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Each row of ``rows`` (k, v) beside each of its group's ``intervals`` (k, lo, hi, more) that holds it, ends excluded.

    A group's intervals, of which there are two for each quantile at most, are one row of the join; frequent groups are joined where they are.
    """
    rest = [c for c in intervals.columns if c != "k"]
    one = intervals.groupBy("k").agg(F.collect_set(F.struct(*rest)).alias("__in"))
    held = skew_join(rows, one, ["k"]).select("k", "v", F.explode(F.filter("__in", lambda i: (i["lo"] < F.col("v")) & (F.col("v") < i["hi"]))).alias("__in"))
    return held.select("k", "v", *(F.col(f"__in.{c}").alias(c) for c in rest))


def _narrowed(rows: DataFrame, wide: DataFrame) -> DataFrame:
    """One round for the order statistics of ``wide``: those found have ``found``, the others a smaller interval."""
    at = F.array(*(F.lit(i / STEPS) for i in range(STEPS + 1)))
    sketch = _within(rows, wide.select("k", *_ENDS).distinct()).groupBy("k", *_ENDS).agg(F.percentile_approx("v", at, ACCURACY).alias("s"))
    step = F.floor(F.col("place") / F.col("inside") * STEPS).cast("int")
    near = materialize(wide.join(sketch, ["k", *_ENDS]).select(*wide.columns, F.get("s", F.greatest(step - 1, F.lit(0))).alias("a"), F.get("s", F.least(step + 2, F.lit(STEPS))).alias("b")), "proposals")
    v, a, b = F.col("v"), F.col("a"), F.col("b")
    counts = _within(rows, near.select("k", *_ENDS, "a", "b").distinct()).groupBy("k", *_ENDS, "a", "b").agg(
        F.count_if(v < a).alias("below"), F.count_if(v == a).alias("at_a"), F.count_if((a < v) & (v < b)).alias("between"), F.count_if((v == b) & (a < b)).alias("at_b"),
    )
    told = near.join(counts, ["k", *_ENDS, "a", "b"])
    place, n = F.col("place"), [F.col(c) for c in ("below", "at_a", "between", "at_b")]
    upto = [reduce(Column.__add__, n[: i + 1]) for i in range(4)]
    part = F.when(place < upto[0], 0).when(place < upto[1], 1).when(place < upto[2], 2).when(place < upto[3], 3).otherwise(4)
    told = told.withColumn("part", part)
    is_ = lambda i: F.col("part") == i
    return told.select(
        "k", "rank",
        F.when(is_(0), F.col("lo")).when(is_(2), a).when(is_(4), b).otherwise(a).alias("lo"),
        F.when(is_(0), a).when(is_(2), b).when(is_(4), F.col("hi")).otherwise(b).alias("hi"),
        F.when(is_(0), n[0]).when(is_(2), n[2]).otherwise(F.col("inside") - upto[3]).alias("inside"),
        F.when(is_(0), place).when(is_(2), place - upto[1]).otherwise(place - upto[3]).alias("place"),
        F.when(is_(1), a).when(is_(3), b).alias("found"),
    )


def exact(df: DataFrame, group: list[str], value: str, at: dict[str, float], most: int = MOST) -> DataFrame:
    """(*``group``, a column for each of ``at``): quantiles by linear interpolation between the two nearest ranks.

    Null and non-finite values take no part; a group without others has no row, a null group is one of its own. Every round reads narrow rows twice and
    exchanges counts; n rows need about log(n / ``most``) / log(64) of them, none up to ``most``.
    """
    v = F.col(value).cast("double")
    rows = materialize(df.select(_key(group).alias("k"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), "values")
    sizes = materialize(rows.groupBy("k").agg(F.count("*").alias("n")), "sizes")
    spot = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.array(*(f(spot(p)).cast("long") for p in at.values() for f in (F.floor, F.ceil))))
    ends = [F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")]
    left = sizes.select("k", F.explode(ranks).alias("rank"), *ends, F.col("n").alias("inside")).select("k", "rank", *_ENDS, "inside", F.col("rank").alias("place"))
    known, small = [], []
    while True:
        small.append(left.where(F.col("inside") <= most))
        wide = left.where(F.col("inside") > most)
        if not wide.limit(1).count():
            break
        told = materialize(_narrowed(rows, wide), "narrowed")
        known.append(told.where(F.col("found").isNotNull()).select("k", "rank", "found"))
        left = told.where(F.col("found").isNull()).drop("found")
    sort = materialize(reduce(DataFrame.unionByName, small), "to-sort")
    sorted_ = _within(rows, sort.select("k", *_ENDS).distinct()).groupBy("k", *_ENDS).agg(F.sort_array(F.collect_list("v")).alias("all"))
    known.append(sort.join(sorted_, ["k", *_ENDS]).select("k", "rank", F.get("all", F.col("place").cast("int")).alias("found")))
    found = reduce(DataFrame.unionByName, known).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "found"))).alias("by_rank"))

    def between(p: float) -> Column:
        low = F.element_at("by_rank", F.floor(spot(p)).cast("long"))
        return low + (F.element_at("by_rank", F.ceil(spot(p)).cast("long")) - low) * (spot(p) - F.floor(spot(p)))

    return sizes.join(found, "k").select(*(F.col(f"k.{c}").alias(c) for c in group), *(between(p).alias(name) for name, p in at.items()))


def beside(stats: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """``stats`` (one row a group) with the columns of ``found``, null where a group has none; groups of nulls match."""
    named = found.withColumn("__k", _key(group)).drop(*group)
    return stats.withColumn("__k", _key(group)).join(named, "__k", "left").drop("__k")
