"""Feature matrices in long form, TF-IDF, centroids, projections and silhouettes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.operators.panels import stratified_sample
from glyphstream.runtime import broadcast_if_small, materialize


def normalized_rows(matrix: DataFrame, key: str, norm: int = 1) -> DataFrame:
    """(key, feature, value) with rows of unit L1 or L2 norm; rows without features stay absent."""
    own = Window.partitionBy(key)
    size = F.sum("value").over(own) if norm == 1 else F.sqrt(F.sum(F.col("value") * F.col("value")).over(own))
    return matrix.withColumn("value", F.try_divide(F.col("value"), size))


def tfidf(matrix: DataFrame, key: str, n_rows: int) -> DataFrame:
    """Counts times ln((1 + n) / (1 + df)) + 1, rows of unit L2 norm. Document frequencies are joined, not windowed,
    and sent to all tasks where they are few, so a common feature stays spread."""
    df_ = matrix.groupBy("feature").agg(F.count("*").alias("df"))
    idf = F.log((1 + n_rows) / (1 + F.col("df"))) + 1
    weighted = matrix.join(broadcast_if_small(df_), "feature").select(key, "feature", (F.col("value") * idf).alias("value"))
    return normalized_rows(weighted, key, 2)


def centroids(matrix: DataFrame, key: str, group: str) -> DataFrame:
    """(group, feature, value): means over all rows of the group, absent features counting as 0."""
    sizes = matrix.select(group, key).distinct().groupBy(group).agg(F.count("*").alias("size"))
    sums = matrix.groupBy(group, "feature").agg(F.sum("value").alias("total"))
    return sums.join(sizes, group).select(group, "feature", (F.col("total") / F.col("size")).alias("value"))


def centroid_distances(means: DataFrame, group: str) -> DataFrame:
    """Euclidean distances of all ordered pairs of groups: |a|^2 + |b|^2 - 2 a.b over shared features."""
    one = means.select(F.col(group).alias("a"), "feature", F.col("value").alias("x"))
    two = means.select(F.col(group).alias("b"), "feature", F.col("value").alias("y"))
    norms = means.groupBy(group).agg(F.sum(F.col("value") * F.col("value")).alias("norm"))
    dots = one.join(two, "feature").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    left = norms.select(F.col(group).alias("a"), F.col("norm").alias("na"), F.lit(1).alias("one"))
    right = norms.select(F.col(group).alias("b"), F.col("norm").alias("nb"), F.lit(1).alias("one"))
    pairs = left.join(right, "one").join(dots, ["a", "b"], "left")
    square = F.col("na") + F.col("nb") - 2 * F.coalesce("dot", F.lit(0.0))
    return pairs.select("a", "b", F.sqrt(F.greatest(square, F.lit(0.0))).alias("distance"))


def top_features(means: DataFrame, group: str, top: int) -> DataFrame:
    place = Window.partitionBy(group).orderBy(F.desc(F.round("value", 9)), "feature")
    return means.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)


def row_entropy(matrix: DataFrame, key: str) -> DataFrame:
    """(key, entropy in bits) of each row's shares; rows without positive features are absent."""
    shares = normalized_rows(matrix.where("value > 0"), key)
    return shares.groupBy(key).agg(F.sum(-F.col("value") * F.log2("value")).alias("entropy"))


def pairwise_distances(points: DataFrame, key: str, vector_col: str, blocks: int = 8) -> DataFrame:
    """(a, b, distance) of all pairs a < b of a bounded set of points (an all-pairs result is the measure itself).

    Points are dealt into blocks, each pair of blocks is one group, and squares that rounding left below 0 are 0.
    """
    part = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    rows = points.select(F.col(key).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), part.alias("p"))
    each = rows.select("id", "v", "p", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")).select("id", "v", "p", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"))

    def distances(group: pd.DataFrame) -> pd.DataFrame:
        x, y = group[group.p == group.i], group[group.p == group.j]
        if x.empty or y.empty:
            return pd.DataFrame()
        a, b = np.stack(x.v.to_list()), np.stack(y.v.to_list())
        d = np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0))
        one, two = x.id.to_numpy()[:, None], y.id.to_numpy()[None, :]
        r, c = np.nonzero((one < two) if group.i.iloc[0] == group.j.iloc[0] else (one != two))
        one, two = x.id.to_numpy()[r], y.id.to_numpy()[c]
        return pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two), "distance": d[r, c]})

    kind = dict(points.dtypes)[key]
    return each.groupBy("i", "j").applyInPandas(distances, f"a {kind}, b {kind}, distance double")


def matrix_summary(matrix: DataFrame, key: str, n_features: int) -> DataFrame:
    """Rows, non-zeros and sparsity of a matrix."""
    one = matrix.agg(F.countDistinct(key).alias("n_rows"), F.count_if(F.col("value") != 0).alias("nnz"))
    return one.withColumn("n_features", F.lit(n_features).cast("long")).withColumn("sparsity", 1 - F.try_divide(F.col("nnz"), F.col("n_rows") * n_features))


def pca(df: DataFrame, vector_col: str, k: int) -> tuple[DataFrame, list[float]]:
    """``df`` with ``projected`` (centred, k values padded with 0), and explained ratios.

    Each component's largest loading is positive. Only the d x d covariance and the loadings reach the driver.
    """
    rows = df.withColumn("__v", array_to_vector(F.transform(vector_col, lambda x: x.cast("double"))))
    mean = rows.select(Summarizer.mean(F.col("__v")).alias("m")).first().m.toArray()
    k_used = min(k, len(mean))
    model = PCA(k=k_used, inputCol="__v", outputCol="__p").fit(rows)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), range(k_used)])
    offset = mean @ loadings
    shifted = [(F.col("__a")[i] - float(offset[i])) * float(signs[i]) for i in range(k_used)] + [F.lit(0.0)] * (k - k_used)
    out = model.transform(rows).withColumn("__a", vector_to_array("__p")).withColumn("projected", F.array(*shifted))
    return out.drop("__v", "__p", "__a"), [float(x) for x in model.explainedVariance]


def silhouette_scores(points: DataFrame, key: str, label: str, vector_col: str, within: list[str] | None = None, blocks: int = 6) -> DataFrame:
    """(*``within``, key, label, ``silhouette``) of every point by Euclidean distance, in each group of ``within`` by itself.

    Points are dealt into blocks; a task takes one pair of blocks and gives each of its first block's points the sums of distances to every
    label of the second, which are added up. A point alone with its label scores 0, a group with one label has no rows. All-pairs work: for bounded samples.
    """
    within, part = within or [], F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    rows = points.select(*within, F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), part.alias("p"))
    sides = F.array(*(F.struct(F.lit(side).alias("side"), F.lit(o).alias("o")) for side in (0, 1) for o in range(blocks)))
    each = rows.select("*", F.explode(sides).alias("x")).select(*within, "id", "label", "v", F.col("x.side").alias("side"), F.when(F.col("x.side") == 0, F.col("p")).otherwise(F.col("x.o")).alias("i"), F.when(F.col("x.side") == 0, F.col("x.o")).otherwise(F.col("p")).alias("j"))

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        x, y = group[group.side == 0], group[group.side == 1]
        if x.empty or y.empty:
            return pd.DataFrame()
        names, at = np.unique(y.label.to_numpy(dtype=object), return_inverse=True)
        a, b = np.stack(x.v.to_list()), np.stack(y.v.to_list())
        d = np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0))
        d[x.id.to_numpy()[:, None] == y.id.to_numpy()[None, :]] = 0
        total = np.stack([d[:, at == g].sum(1) for g in range(len(names))], 1)
        out = {c: group[c].iloc[0] for c in within} | {"id": np.repeat(x.id.to_numpy(), len(names)), "label": np.repeat(x.label.to_numpy(dtype=object), len(names))}
        return pd.DataFrame(out | {"other": np.tile(names, len(x)), "total": total.ravel(), "n": np.tile(np.bincount(at), len(x))})

    kinds = dict(points.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in within), f"id {kinds[key]}", "label string, other string, total double, n long"])
    met = each.groupBy(*within, "i", "j").applyInPandas(sums, schema).groupBy(*within, "id", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("label") == F.col("other")
    one = met.groupBy(*within, "id", "label").agg(F.max(F.when(own, F.col("n"))).alias("size"), F.max(F.when(own, F.try_divide("total", F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    score = F.when(F.col("size") > 1, F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).otherwise(F.lit(0.0))
    return one.where(F.col("b").isNotNull()).select(*within, F.col("id").alias(key), F.col("label").alias(label), score.alias("silhouette"))


def silhouettes(points: DataFrame, key: str, label: str, vector_col: str, within: list[str] | None = None) -> DataFrame:
    """(*``within``, ``silhouette``, ``n``): means of the points; null where the labels are fewer than two or as many as points."""
    within = within or []
    scores = silhouette_scores(points, key, label, vector_col, within)
    means = scores.groupBy(*within).agg(F.avg("silhouette").alias("silhouette"), F.count("*").alias("n"), F.countDistinct(label).alias("__labels"))
    return means.select(*within, F.when(F.col("__labels").between(2, F.col("n") - 1), F.col("silhouette")).alias("silhouette"), "n")


def silhouette(df: DataFrame, vector_col: str, label: str, key: str, cap: int = 2000, seed: int = 42) -> float | None:
    """Mean Euclidean silhouette of at most ``cap`` rows, sampled by label; null with fewer than two labels.

    The cap is the measure's definition: it keeps the all-pairs distances bounded.
    """
    sample = materialize(stratified_sample(df, cap, [label], seed, key).select(key, label, vector_col), "sample")
    return silhouettes(sample, key, label, vector_col).first()["silhouette"]
