"""Session helpers shared by every operator: tables, cut lineage, shuffle sizing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any Hadoop file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only where that is unset a folder of our own is taken: a temporary one in
    local mode, else one in the warehouse, which all executors share.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="glyphstream-")
        else:
            _OWN_DIR[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_glyphstream"
    return _OWN_DIR[app]


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage in a form that outlives any executor, is compressed, and
    gives the planner true sizes, so joins on the result choose broadcast or
    shuffle by a checked size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glyphstream/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> bool:
    """Delete this application's intermediate tables, once results are written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{shared_dir(spark)}/glyphstream/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that are broadcast at most where a count decides: narrow rows of ids and labels, some 90 bytes each as measured, so 22 MB.
BROADCAST_ROWS = 250_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted small; else as it is, for a shuffled join.

    For narrow tables only (ids, labels), whose rows have a known width.
    """
    return F.broadcast(df) if df.count() <= rows else df


#: Keys that are joined by broadcast at most where they are frequent.
HOT_KEYS = 10_000


def skew_join(left: DataFrame, right: DataFrame, key: list[str], size: str | None = None, least: int = 10_000) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has each key once, by the columns ``key``.

    ``size`` names the column of ``right`` that counts the key's rows in ``left``, if there is one.

    Keys with more than a ten-thousandth of ``left``'s rows (and more than ``least``) are joined by
    broadcast where their rows are, so no key fills a task. There are at most ``HOT_KEYS`` such keys,
    whatever the size of the tables; null keys never match. Both sides should be cheap to read twice.
    """
    sizes = left.groupBy(*key).agg(F.count("*").alias("__n")) if size is None else right.select(*key, F.col(size).alias("__n"))
    sizes = materialize(sizes.where(F.col("__n") > least), "sizes")  # keys that could be frequent
    if not sizes.limit(1).count():
        return left.join(right, key)
    limit = max(least, left.count() // HOT_KEYS)
    hot = F.broadcast(sizes.where(F.col("__n") > limit).select(*key))
    return left.join(F.broadcast(right.join(hot, key, "left_semi")), key).unionByName(left.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key))


def many_join(left: DataFrame, right: DataFrame, key: list[str], part: int = 50_000) -> DataFrame:
    """Inner join of ``left`` with a narrower ``right``, both of which may hold a key often.

    Rows of ``left`` whose key it holds more than ``part`` times are dealt out in parts of that size by a hash of the whole row, and the key's
    rows of ``right`` go to each part, so no task joins more than ``part`` rows of one key. Null keys never match.
    """
    sizes = left.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > part)
    large = materialize(sizes.select(*key, F.ceil(F.col("__n") / part).cast("int").alias("__parts")), "large")
    if not large.limit(1).count():
        return left.join(right, key)
    large, parts = broadcast_if_small(large), F.coalesce("__parts", F.lit(1))
    dealt = left.join(large, key, "left").withColumn("__part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("__parts")
    every = right.join(large, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(every, [*key, "__part"]).drop("__part")


def ranked(df: DataFrame, order: list[str], group: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with the exact rank from 0 of each row by ``order`` (within ``group``), without one task for all rows.

    Rows are exchanged by range and sorted; a rank is a row's place in its partition and the counts of
    the partitions before, of which there is one row for each partition (and group). Nulls come first;
    rows that are equal in ``order`` get ranks of their own, in any order.
    """
    group = group or []
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    laid = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    laid = materialize(laid.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), "ranked")
    runs = laid.groupBy(*group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*(group or [F.lit(1)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(group)), F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    place: Column = F.col("__base") + F.col("__at") - F.col("__first")
    if not group:
        runs = F.broadcast(runs)  # one row a partition
    return laid.join(runs, same).select(*df.columns, place.cast("long").alias(name))
