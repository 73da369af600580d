"""Sinks: FASTA, Parquet, guarded CSV and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphstream.operators.retrieval import require_safe

FORBIDDEN = {"sequence", "raw_sequence", "refined_sequence", "s"}


def write_fasta(df: DataFrame, path: str, id_col: str = "seq_id", seq_col: str = "sequence") -> None:
    df.select(F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), F.col(seq_col))).write.text(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    (df.write.partitionBy(*by) if by else df.write).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """An aggregate table as CSV, sequence columns dropped, long symbol runs refused."""
    require_safe(df.drop(*FORBIDDEN), FORBIDDEN).write.option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    require_safe(df, FORBIDDEN).write.json(path)


def safe_records(df: DataFrame, most: int | None = None) -> DataFrame:
    """Rows fit for JSON: doubles rounded to 6 places, NaN and infinities null."""
    def clean(name: str, kind: str) -> Column:
        if kind not in ("double", "float"):
            return F.col(name)
        c = F.col(name)
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c, 6)).alias(name)

    rows = df.select(*(clean(n, k) for n, k in df.dtypes))
    return rows if most is None else rows.limit(most)


def markdown(df: DataFrame, most: int = 20) -> str:
    """A table for a report, at most ``most`` rows, with a note if there are more."""
    rows = df.limit(most + 1).collect()
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(show(v) for v in r) + " |" for r in rows[:most]]
    return "\n".join(lines + ([f"(first {most} rows)"] if len(rows) > most else []))
