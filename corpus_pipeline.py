"""The corpus pipeline: toxicity, line dedup, near-dedup, personal data, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns what the next one gets as ``docs``. All stages but the last return
the columns of ``documents``; the last returns one row per packed piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.llm import line_dedup, near_dup, packing, pii, toxicity
from glyphstream.llm.queries import PACK_ADDED, PACK_CLOSING_ID, PACK_RANKS, PACK_SIZE, TOXIC
from glyphstream.runtime import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document of which other documents hold at least so many characters, and all but less than such a share, is a copy.
LOST, STAYS = 300, 0.2


def _held_elsewhere(runs: Column, own: Column) -> Column:
    """Characters of the runs (start, end, source) that other documents keep, each counted once."""
    others = F.array_sort(F.filter(runs, lambda r: r["source"] != own))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))
    step = lambda s, r: F.struct(
        F.greatest(s["at"], r["end"]).alias("at"), (s["n"] + F.greatest(r["end"] - F.greatest(r["start"], s["at"]), F.lit(0))).alias("n")
    )
    return F.aggregate(others, start, step, lambda s: s["n"])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the rejecting one; learnt from labels that aren't held out.

    Null and empty texts have no evidence and stay; rows without id and repeated rows are judged like any others;
    other columns than those of documents go; without labels of both kinds all stay; no rows give no rows.
    """
    model = toxicity.learn_from(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs.select(*COLUMNS), model, TOXIC)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs and lines; a document that was nothing but these goes, and one
    of which other documents hold ``LOST`` characters and all but less than the share ``STAYS``: a copy of which scraps are left.

    Of equal texts the one with the least id keeps its text. Null and empty texts, rows without id and the texts of
    rows that share an id stay; ``n_chars`` is the new length where a text was cut; no rows give no rows.
    """
    rows = line_dedup.dedup_lines(docs.select(*COLUMNS, F.coalesce(F.length("text"), F.lit(0)).alias("__size")))
    cut = F.size("removed_runs") > 0
    held = _held_elsewhere(F.col("removed_runs"), F.col("doc_id"))
    emptied = ~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    copied = cut & (emptied | ((held >= LOST) & (F.col("__size") - held < STAYS * F.col("__size"))))
    return rows.where(~copied).withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by a similarity of 0.8 on five-word shingles.

    Texts without words, null ones included, and rows without id are linked with nothing and stay; rows that share a
    kept id all stay; no rows give no rows.
    """
    return near_dup.drop_near_duplicates(docs.select(*COLUMNS), near_dup.Settings())


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with [KIND] in place of every span of personal data; every row stays.

    Null and empty texts stay as they are; spans that overlap become one; ``n_chars`` is the new length where a text was
    changed; no rows give no rows.
    """
    clean = pii.redacted(F.col("text"))
    rows = docs.select("doc_id", F.col("text").alias("old"), clean.alias("text"), "lang", "source", "n_chars")
    changed = ~F.col("old").eqNullSafe(F.col("text"))
    return rows.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and offset.

    Null and empty texts are one closing id; rows without id and repeated rows are packed each; no rows give no rows.
    """
    return packing.pack(docs, PACK_RANKS, public_tokenizers.PATTERN, PACK_CLOSING_ID, PACK_SIZE, added=PACK_ADDED)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: The learnt scores, token ids and packing can't be written in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
