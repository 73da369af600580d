"""Bootstrap, temporal and ranking operators. Draws come from hashes, so they repeat in any layout."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.functions import sequence as q
from glyphstream.operators import quantiles, tokens
from glyphstream.runtime import ranked


#: Replicates that one task draws: so many times less is the distribution copied.
TOGETHER = 20


def drawn(size: Column, *keys: Column) -> Column:
    """A number from 1 to ``size``, from 12 hex digits of a SHA-256 of the keys."""
    digest = F.sha2(F.concat_ws("|", *(k.cast("string") for k in keys)), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), size) + 1


def bootstrap_rows(df: DataFrame, group: str, key: str, replicates: int, per_group: int, seed: int) -> DataFrame:
    """(replicate, draw, row): per group and replicate min(per_group, size) draws with replacement.

    Draws are made from group sizes alone, then joined to ranked rows by number. Ranks come from range partitions
    and their counts, so no task sorts a group.
    """
    places = ranked(df, [key], [group], "at").withColumn("at", F.col("at") + 1)
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    draws = sizes.select(group, "size", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    draws = draws.select(group, "size", "replicate", F.explode(F.sequence(F.lit(1).cast("long"), F.least("size", F.lit(per_group).cast("long")))).alias("draw"))
    draws = draws.select(group, "replicate", "draw", drawn(F.col("size"), F.lit(seed), F.col(group), F.col("replicate"), F.col("draw")).alias("at"))
    return draws.join(places, [group, "at"]).drop("at")


def interval(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean, deviation (0 for one value) and 95 % interval of finite values."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    stats = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    ends = quantiles.exact(rows, group, value, {"low": 0.025, "high": 0.975})
    return quantiles.beside(stats, ends, group).withColumn("width", F.col("high") - F.col("low"))


def resampled_counts(dist: DataFrame, group: str, replicates: int, cap: int, seed: int) -> DataFrame:
    """(replicate, group, token, n): multinomial redraws of each group's counts, min(total, cap) tokens each.

    A task holds one group's vocabulary, which the token length bounds, and draws ``TOGETHER`` replicates of it; the seed
    of each is a hash of group and replicate.
    """
    parts = -(-replicates // TOGETHER)
    spread = dist.select(group, "token", "n", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def redraw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("token")
        total, names, share = int(rows.n.sum()), rows.token.to_numpy(), rows.n.to_numpy(float)
        out = []
        for replicate in range(key[1] * TOGETHER + 1, min((key[1] + 1) * TOGETHER, replicates) + 1):
            own = int.from_bytes(sha256(f"{seed}|{key[0]}|{replicate}".encode()).digest()[:8], "little")
            n = np.random.default_rng(own).multinomial(min(total, cap), share / total)
            out.append(pd.DataFrame({"replicate": replicate, group: key[0], "token": names[n > 0], "n": n[n > 0]}))
        return pd.concat(out)

    return spread.groupBy(group, "part").applyInPandas(redraw, f"replicate int, {group} string, token string, n long")


def bootstrap_divergence(dist: DataFrame, group: str, replicates: int, cap: int, seed: int) -> DataFrame:
    """(replicate, a, b, distance) for a < b."""
    redrawn = resampled_counts(dist, group, replicates, cap, seed)
    shares = redrawn.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("replicate", group)))
    one = shares.select("replicate", F.col(group).alias("a"), "token", F.col("share").alias("p"))
    two = shares.select("replicate", F.col(group).alias("b"), "token", F.col("share").alias("r"))
    p, r = F.col("p"), F.col("r")
    part = one.join(two, ["replicate", "token"]).where("a < b").groupBy("replicate", "a", "b").agg(F.sum(p * F.log2(p / (p + r)) + r * F.log2(r / (p + r))).alias("part"))
    return part.select("replicate", "a", "b", F.sqrt(F.greatest(1 + 0.5 * F.col("part"), F.lit(0.0))).alias("distance"))


def top_sets(dist: DataFrame, keys: list[str], top: int) -> DataFrame:
    """(keys, tokens): the set of each group's top tokens by count, ties by token."""
    place = Window.partitionBy(*keys).orderBy(F.desc("n"), "token")
    rows = dist.withColumn("__at", F.row_number().over(place)).where(F.col("__at") <= top)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set("token")).alias("tokens"))


def top_stability(dist: DataFrame, group: str, replicates: int, cap: int, top: int, seed: int) -> DataFrame:
    """Jaccard of each replicate's top tokens with the group's own."""
    own = top_sets(dist, [group], top).withColumnRenamed("tokens", "reference")
    each = top_sets(resampled_counts(dist, group, replicates, cap, seed), ["replicate", group], top)
    joined = each.join(own, group, "left")
    return joined.select("replicate", group, q.jaccard(F.col("tokens"), F.coalesce("reference", F.array().cast("array<string>"))).alias("jaccard"))


def usable_windows(df: DataFrame, window: str, group: str, groups: int, least: int) -> DataFrame:
    """Windows in which all groups occur, each at least ``least`` times."""
    sizes = df.groupBy(window, group).agg(F.count("*").alias("n"))
    return sizes.groupBy(window).agg(F.count("*").alias("groups"), F.min("n").alias("least")).where((F.col("groups") == groups) & (F.col("least") >= least)).select(window)


def temporal_divergence(df: DataFrame, by: tokens.Tokenizer, window: str, group: str, groups: int, least: int) -> DataFrame:
    """(window, a, b, distance) between groups of each usable window, a < b, and a row of their mean (a = b = 'mean')."""
    usable = usable_windows(df, window, group, groups, least)
    dist = tokens.distribution(tokens.counts(df.join(usable, window, "left_semi"), by, [window, group]), [window, group])
    one = dist.select(window, F.col(group).alias("a"), "token", F.col("share").alias("p"))
    two = dist.select(window, F.col(group).alias("b"), "token", F.col("share").alias("r"))
    p, r = F.col("p"), F.col("r")
    part = one.join(two, [window, "token"]).where("a < b").groupBy(window, "a", "b").agg(F.sum(p * F.log2(p / (p + r)) + r * F.log2(r / (p + r))).alias("part"))
    pairs = part.select(window, "a", "b", F.sqrt(F.greatest(1 + 0.5 * F.col("part"), F.lit(0.0))).alias("distance"))
    return pairs.unionByName(pairs.groupBy(window).agg(F.avg("distance").alias("distance")).select(window, F.lit("mean").alias("a"), F.lit("mean").alias("b"), "distance"))


def scaled(value: Column, higher_is_better: bool = True) -> Column:
    """Min-max over all rows; a constant column is 1, or 0 when lower is better."""
    all_ = Window.partitionBy(F.lit(1))
    low, high = F.min(value).over(all_), F.max(value).over(all_)
    up = F.when(high == low, F.lit(1.0)).otherwise(F.try_divide(value - low, high - low))
    return up if higher_is_better else 1.0 - up


def ranking(df: DataFrame, key: str, better: dict[str, bool]) -> DataFrame:
    """Mean of min-max scores (metric to whether higher is better), ranked, ties by key."""
    scores = [scaled(F.col(c).cast("double"), up) for c, up in better.items()]
    rated = df.select(key, *(s.alias(f"{c}_score") for s, c in zip(scores, better)))
    rated = rated.withColumn("robustness", sum((F.col(f"{c}_score") for c in better), F.lit(0.0)) / len(better))
    return rated.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("robustness", 9)), key)))


def tokenizer_ranking(js: DataFrame, jaccard: DataFrame, entropy: DataFrame, coverage: DataFrame) -> DataFrame:
    """Robustness of tokenizers, ranked: five scores from summaries of bootstraps and coverage, averaged.

    ``js`` (tokenizer, mean, width) holds one row each and says which tokenizers are ranked; ``jaccard`` and ``entropy``
    (tokenizer, mean, width) one row a group; ``coverage`` (tokenizer, n_sequences). A score that is missing is left out of the mean.
    """
    top = jaccard.groupBy("tokenizer").agg(F.avg("mean").alias("jaccard"))
    spread = entropy.groupBy("tokenizer").agg(F.avg("width").alias("entropy_width"))
    rows = js.select("tokenizer", F.col("mean").alias("js"), F.col("width").alias("js_width"))
    for other in (top, spread, coverage.select("tokenizer", "n_sequences").distinct()):
        rows = rows.join(other, "tokenizer", "left")
    scores = [scaled(F.col("js")), scaled(F.col("js_width"), False), scaled(F.col("jaccard")), scaled(F.col("entropy_width"), False),
              F.try_divide(F.col("n_sequences").cast("double"), F.max("n_sequences").over(Window.partitionBy(F.lit(1))))]
    names = ["js_score", "js_stability_score", "jaccard_score", "entropy_stability_score", "coverage_score"]
    rated = rows.select("tokenizer", *(x.alias(n) for x, n in zip(scores, names)))
    known = F.filter(F.array(*names), lambda x: x.isNotNull())
    rated = rated.withColumn("robustness", F.aggregate(known, F.lit(0.0), lambda a, b: a + b) / F.size(known))
    return rated.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("robustness", 9)), "tokenizer")))
