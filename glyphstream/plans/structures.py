"""Structure entries mapped to the consensus of their group: quality rows and positions with signals.

The items of ``benchmark`` stand for structure entries; the languages of ``documents`` are the subtypes, even and odd numbers the two proteins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.functions import codon, sequence as q
from glyphstream.operators import align
from glyphstream.plans.queries import query, r6, sequences
from glyphstream.runtime import materialize, table

SUBTYPES, PROTEINS = ["de", "en", "es", "fr"], ["HA", "NA"]


def _one_of(names: list[str], number: str) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.col(number) % len(names)).cast("int") + 1)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item as an entry of structures of five items: its text as a sequence, translated."""
    items = table(spark, sf_dir, "benchmark")
    protein = codon.translated(q.encoded(F.col("text")))
    number = F.floor(F.col("item_id") / 5)
    return items.select(
        F.concat(F.lit("S"), number).alias("structure"), F.col("item_id").alias("entity"), F.concat(F.lit("chain "), F.col("item_id") % 5).alias("chains"),
        _one_of(SUBTYPES, "item_id").alias("subtype"), F.element_at(F.array(*map(F.lit, PROTEINS)), (number % 2).cast("int") + 1).alias("protein"), protein.alias("sequence"),
    )


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    panel = sequences(spark, sf_dir).select(F.col("lang").alias("subtype"), _one_of(PROTEINS, "doc_id").alias("protein"), "s")
    panel = panel.withColumn("group", F.concat_ws("-", "protein", "subtype"))
    counted = materialize(align.codons_at(panel, ["subtype", "protein", "group"], "s"), "codons")
    cons = align.consensus_of(counted, "group")
    parts = F.split("group", "-")
    cons = cons.select(parts[1].alias("subtype"), parts[0].alias("protein"), "consensus")
    signals = align.signals_of(counted, ["subtype", "protein", "group"]).withColumn("at", F.col("at") + 1)
    return align.structure_tables(entries(spark, sf_dir), materialize(cons, "consensus"), materialize(signals, "signals"))


@query()
def structure_quality(spark, sf_dir):
    """A quality row for every entry of every structure."""
    qc, _ = _tables(spark, sf_dir)
    return qc.withColumns({c: F.round(c, 6) for c in ("identity", "coverage_structure", "coverage_local")})


@query()
def structure_mapping(spark, sf_dir):
    """Positions of every entry on its group's consensus, with the signals of subtype, protein, group and position."""
    _, mapping = _tables(spark, sf_dir)
    return mapping.select(*align.ENTRY, "group", "at", "structure_at", "n", *(r6(c, c) for c in ("gc", "cg", "ta", "unclear", "entropy", "dominant")))
