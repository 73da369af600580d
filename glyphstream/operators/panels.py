"""Panels: quality flags, checked joins, ordered deduplication, balanced samples, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.functions import sequence as q
from glyphstream.operators import quantiles
from glyphstream.runtime import materialize, ranked


def require_columns(df: DataFrame, needed: set[str], label: str) -> None:
    """Fail at analysis time if a table lacks columns."""
    if missing := sorted(needed - set(df.columns)):
        raise ValueError(f"{label} lacks columns: {missing}")


def quality_flags(s: Column, least: int, most: int, ambiguous: float) -> list[Column]:
    """Length, ambiguity and alphabet flags of a sequence, and ``passes``."""
    long_enough, short_enough = F.length(s) >= least, F.length(s) <= most
    clear, valid = q.ambiguous_fraction(s) <= ambiguous, q.invalid_count(s) == 0
    return [
        long_enough.alias("long_enough"), short_enough.alias("short_enough"), clear.alias("clear"), valid.alias("valid_alphabet"),
        (long_enough & short_enough & clear & valid).alias("passes"),
    ]


QC = ["length", "ambiguous", "invalid", "long_enough", "short_enough", "length_ok", "clear", "valid_alphabet", "passes"]


def sequence_qc(s: Column, least: int | None, most: int | None, ambiguous: float = 0.01) -> list[Column]:
    """Length, ambiguity and symbol counts of a normalised sequence and the six flags they give, named by ``QC``;
    a bound that is None always holds, so each segment can have its own."""
    n, share, invalid = F.length(s), q.ambiguous_fraction(s), q.invalid_count(s)
    low = F.lit(True) if least is None else n >= least
    high = F.lit(True) if most is None else n <= most
    clear, valid = share <= ambiguous, invalid == 0
    return [n.cast("long"), share, invalid.cast("long"), low, high, low & high, clear, valid, low & high & clear & valid]


def filtered_records(df: DataFrame, least: dict[str, int], ambiguous: float, order: list[str], seq_col: str = "s", segment_col: str = "segment") -> DataFrame:
    """Records long enough for their segment and clear enough, the first of each sequence by a total order."""
    bound = F.coalesce(*(F.when(F.col(segment_col) == k, F.lit(v)) for k, v in least.items()), F.lit(0))
    rows = df.where((F.length(seq_col) >= bound) & (q.ambiguous_fraction(F.col(seq_col)) <= ambiguous)).withColumn("__key", F.sha2(seq_col, 256))
    return keep_first(rows, ["__key"], [F.col(c) for c in order]).drop("__key")


def preferred(df: DataFrame, wishes: list[Column], least: int) -> DataFrame:
    """The rows that meet all wishes, or all rows if fewer than ``least`` do."""
    wanted = df
    for wish in wishes:
        wanted = wanted.where(wish)
    return wanted if wanted.limit(least).count() >= least else df


def stage_measures() -> list[Column]:
    """What a summary of a panel counts over pairs: rows, records, distinct pairs, subtypes, metadata, years."""
    distinct = F.countDistinct("pair_sha")
    return [
        F.count("*").alias("n_pairs"), (2 * F.count("*")).alias("n_records"), distinct.alias("n_unique"), (F.count("*") - distinct).alias("n_duplicates"),
        F.count_if("rich").alias("n_rich"), F.count_if("human").alias("n_human"), F.coalesce(F.min("year"), F.lit(0)).alias("year_min"), F.coalesce(F.max("year"), F.lit(0)).alias("year_max"),
    ]


def join_one(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join to a table that must hold each key once; a repeated key is an error when the join runs."""
    once = right.groupBy(key).agg(*(F.first(c).alias(c) for c in right.columns if c != key), F.count("*").alias("__n"))
    checked = once.withColumn(key, F.when(F.col("__n") > 1, F.raise_error(F.lit(f"{key} is not unique"))).otherwise(F.col(key))).drop("__n")
    return left.join(checked, key, how)


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first by a total order: the same rows in any layout."""
    place = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__at", F.row_number().over(place)).where("__at = 1").drop("__at")


def sample(df: DataFrame, size: int, seed: int, key: str) -> DataFrame:
    """A fixed-size sample by hash order; all rows if there are fewer."""
    return df.orderBy(q.sha_rank(seed, F.col(key)), key).limit(size)


def _first_of_each(rows: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """The first ``size`` rows of each group with their place ``__p``. Each group is first cut in 64 parts, of which
    the same holds, so that no task sorts a whole group."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(64)))
    part = F.row_number().over(Window.partitionBy(*group, "__salt").orderBy(*order))
    few = salted.withColumn("__p", part).where(F.col("__p") <= size).drop("__p", "__salt")
    return few.withColumn("__p", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__p") <= size)


def balanced_sample(df: DataFrame, target: int, stratum: str, part: str, seed: int, key: str) -> DataFrame:
    """About ``target`` rows, balanced over strata, and over parts within a stratum.

    Quotas split the target evenly, the first strata by name taking the
    remainder. In a stratum each part gives at most ceil(quota / parts), at least
    one, in hash order; a stratum over its quota is trimmed and one under it is
    filled from its other rows, both in hash order; then the same is done once
    over all rows. With no more than ``target`` rows, all are returned.
    """
    rank = q.sha_rank(seed, F.col(key))
    rows = df.withColumn("__r", rank)
    sizes = rows.groupBy(stratum).agg(F.countDistinct(part).alias("__parts"))
    n_strata = F.count("*").over(Window.partitionBy(F.lit(1)))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(stratum))
    sizes = sizes.withColumn("__quota", (F.floor(F.lit(target) / n_strata) + (place <= F.lit(target) % n_strata).cast("int")).cast("long"))
    sizes = sizes.withColumn("__cap", F.greatest(F.lit(1), F.ceil(F.col("__quota") / F.col("__parts"))))
    rows = rows.join(F.broadcast(sizes), stratum)  # one row per stratum
    rows = _first_of_each(rows, [stratum, part], ["__r", key], target)  # no stratum can give more than the target
    rows = rows.withColumn("__later", (F.col("__p") > F.col("__cap")).cast("int"))
    rows = rows.withColumn("__s", F.row_number().over(Window.partitionBy(stratum).orderBy("__later", "__r", key)))
    rows = rows.withColumn("__over", (F.col("__s") > F.col("__quota")).cast("int"))
    return rows.orderBy("__over", "__r", key).limit(target).select(*df.columns)


def stratified_sample(df: DataFrame, size: int, strata: list[str], seed: int, key: str) -> DataFrame:
    """Equal shares of each stratum in hash order, the remainder filled from all other rows."""
    rows = df.withColumn("__r", q.sha_rank(seed, F.col(key)))
    n = df.select(*strata).distinct().count()
    rows = _first_of_each(rows, strata, ["__r", key], size)
    return rows.orderBy((F.col("__p") > max(1, size // max(n, 1))).cast("int"), "__r", key).limit(size).select(*df.columns)


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing, share) over the named columns."""
    one = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    long = one.unpivot("n", columns, "column", "missing")
    return long.select("column", "missing", F.try_divide("missing", F.col("n")).alias("share"))


def summary_stats(df: DataFrame, group: list[str], metrics: list[str]) -> DataFrame:
    """Long-form count, mean, median, deviation (ddof 1), 5 % and 95 % quantiles of each metric and group."""
    long, v = materialize(df.unpivot(group, metrics, "metric", "value"), "metrics"), "value"
    stats = long.groupBy(*group, "metric").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    found = quantiles.exact(long, [*group, "metric"], v, {"median": 0.5, "q05": 0.05, "q95": 0.95})
    return quantiles.beside(stats, found, [*group, "metric"]).select(*group, "metric", "n", "mean", "median", "std", "q05", "q95")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, low, high, n) of equal-width bins over the values' range; the last bin is closed."""
    ends = df.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    if ends.low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    width = (float(ends.high) - float(ends.low)) / bins or 1.0
    at = F.least(F.floor((F.col(value) - ends.low) / width).cast("int"), F.lit(bins - 1))
    low = F.lit(float(ends.low)) + F.col("bin") * width
    return df.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select("bin", low.alias("low"), (low + width).alias("high"), "n")


def quantile_bins(df: DataFrame, value: str, bins: int, key: str) -> DataFrame:
    """Bins 1..bins of equal rank width; ranks are by value, ties by key."""
    rows = ranked(df.where(F.col(value).isNotNull()), [value, key], name="__r")
    n = rows.count()
    return rows.withColumn("bin", F.greatest(F.lit(1), F.call_function("div", F.col("__r") * bins + max(n - 1, 1) - 1, F.lit(max(n - 1, 1)))).cast("long")).drop("__r")
