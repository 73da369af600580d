"""Codons: table, translation, quality, and rescue of misframed coding sequences."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphstream.functions import sequence as q
from glyphstream.runtime import materialize

#: Fixed value: the standard genetic code, codons in the order of bases T, C, A, G.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), AMINO)}
STOPS = sorted(c for c, a in CODONS.items() if a == "*")


def ambiguous_code() -> dict[str, str]:
    """All codons over A, C, G, T, N: the amino acid that every expansion of N gives, else X."""
    code = {}
    for c in map("".join, product("ACGTN", repeat=3)):
        found = {CODONS["".join(x)] for x in product(*("ACGT" if b == "N" else b for b in c))}
        code[c] = found.pop() if len(found) == 1 else "X"
    return code


def codon_dimension(spark: SparkSession) -> DataFrame:
    """64 rows: codon, amino acid, degeneracy, stop."""
    of = {a: sum(x == a for x in AMINO) for a in AMINO}
    rows = [(c, a, of[a], a == "*") for c, a in sorted(CODONS.items())]
    return spark.createDataFrame(rows, "codon string, amino string, degeneracy int, stop boolean")


def trimmed(s: Column) -> Column:
    """The sequence without the one or two symbols after its last codon."""
    return F.substr(s, F.lit(1), F.length(s) - F.length(s) % 3)


def valid_frame(s: Column) -> Column:
    return (F.length(s) > 0) & (F.length(s) % 3 == 0)


def translated(s: Column) -> Column:
    """Amino acids of the whole codons; X where a codon is not decided.

    Bases become digits, so that a codon is a number that indexes one array.
    """
    base = {b: str(i) for i, b in enumerate("ACGTN")}
    code = ["X"] * 445
    for c, amino in ambiguous_code().items():
        code[int("".join(map(base.get, c)))] = amino
    table = F.split(F.lit("".join(code)), "")
    numbers = F.transform(q.stepped(F.translate(s, "ACGTN-+ ", "01234xxx"), 3), lambda c: c.try_cast("int"))
    return q.let(table, lambda t: F.array_join(F.transform(numbers, lambda i: F.coalesce(F.get(t, i), F.lit("X"))), ""))


def internal_stops(amino: Column) -> Column:
    """Stops before the last residue."""
    return F.when(F.length(amino) <= 1, F.lit(0)).otherwise(F.regexp_count(F.substr(amino, F.lit(1), F.length(amino) - 1), F.lit("\\*")))


def quality(s: Column) -> list[Column]:
    """Translation quality of a sequence; ``codon_reliable`` if nothing failed."""
    amino = translated(s)
    frame, ambiguous = ~F.coalesce(valid_frame(s), F.lit(False)), q.count_of(s, q.SYMBOLS) < F.length(s)
    stops = internal_stops(amino)
    return [
        frame.alias("frame_fail"),
        ambiguous.alias("ambiguous_fail"),
        (stops > 0).alias("internal_stop_fail"),
        stops.cast("long").alias("internal_stops"),
        F.length(amino).cast("long").alias("amino_length"),
        F.endswith(amino, F.lit("*")).alias("terminal_stop"),
        (~frame & ~ambiguous & (stops == 0)).alias("codon_reliable"),
    ]


def codon_counts(df: DataFrame, id_cols: list[str], seq_col: str) -> DataFrame:
    """(ids, codon, n) in frame 0, A, C, G, T codons only."""
    each = df.select(*id_cols, F.explode(q.stepped(F.col(seq_col), 3)).alias("codon"))
    return each.where(F.col("codon").rlike("^[ACGT]{3}$")).groupBy(*id_cols, "codon").agg(F.count("*").alias("n"))


def usage(counts: DataFrame, id_cols: list[str]) -> DataFrame:
    """Frequency over all codons of the row, and relative synonymous usage (null for stops)."""
    spark = counts.sparkSession
    own = Window.partitionBy(*id_cols)
    amino = Window.partitionBy(*id_cols, "amino")
    rows = counts.join(F.broadcast(codon_dimension(spark)), "codon")  # 64 rows
    rscu = F.when(~F.col("stop"), F.col("n") * F.col("degeneracy") / F.sum("n").over(amino))
    return rows.select(*id_cols, "codon", "amino", "n", (F.col("n") / F.sum("n").over(own)).alias("frequency"), rscu.alias("rscu"))


@dataclass(frozen=True)
class Rescue:
    """Trims tried at both ends, and bounds of an accepted translation."""

    left: int = 2
    right: int = 2
    ambiguous: float = 0.02
    least: int = 1
    most: int = 100_000
    stops: int = 0
    unknown: int = 0


def rescued(df: DataFrame, seq_col: str = "s", rules: Rescue = Rescue()) -> DataFrame:
    """``df`` without the sequence, and the status of a coding sequence and the trim that mends it.

    The gap-free sequence is ``empty``, ``ambiguous``, ``strict_pass`` if it is
    accepted as it is, else ``rescued`` by the acceptable trim of least score
    (1000 a stop, 100 an X, 1 without a closing stop), then shortest, then least
    left trim; else ``unrescued``. Of all trims only one right trim is in frame for each left one,
    so there are as many translations as left trims, each a column that is made once.
    """
    kept = [c for c in df.columns if c != seq_col]
    rows = df.select(*kept, q.cleaned(F.col(seq_col)).alias("__raw"))
    rows = rows.select(*kept, F.length("__raw").alias("__raw_size"), F.replace("__raw", F.lit("-"), F.lit("")).alias("__s"))
    n = F.length("__s")
    right = lambda l: F.pmod(n - l, F.lit(3))
    fits = lambda l: (n - l - right(l) > 0) & (right(l) <= rules.right)
    cut = lambda l: F.when(fits(l), F.substr("__s", F.lit(l + 1), n - l - right(l)))
    lefts = range(rules.left + 1)
    rows = rows.select("*", *(cut(l).alias(f"__cut{l}") for l in lefts))
    rows = rows.select(*kept, "__raw_size", "__s", *(F.when(q.invalid_count(F.col(f"__cut{l}")) == 0, translated(F.col(f"__cut{l}"))).alias(f"__a{l}") for l in lefts))

    def rated(l: int) -> Column:
        a = F.col(f"__a{l}")
        stops, unknown = internal_stops(a), F.length(a) - F.length(F.replace(a, F.lit("X"), F.lit("")))
        accepted = (stops <= rules.stops) & (unknown <= rules.unknown) & F.length(F.rtrim(a, F.lit("*"))).between(rules.least, rules.most)
        score = (1000 * stops + 100 * unknown + F.when(F.endswith(a, F.lit("*")), 0).otherwise(1)).cast("long")
        return F.when(accepted, F.struct(score.alias("score"), (l + right(l)).cast("int").alias("trimmed"), F.lit(l).alias("left"), right(l).cast("int").alias("right")))

    rows = rows.select(*kept, "__raw_size", n.alias("__n"), q.ambiguous_fraction(F.col("__s")).alias("__share"), F.array_compact(F.array(*map(rated, lefts))).alias("__ok"))
    best, used = F.array_min("__ok"), F.col("status").isin("strict_pass", "rescued")
    status = (
        F.when(F.col("__n") == 0, F.lit("empty")).when(F.col("__share") > rules.ambiguous, F.lit("ambiguous"))
        .when(F.exists("__ok", lambda c: c["trimmed"] == 0), F.lit("strict_pass")).when(F.size("__ok") > 0, F.lit("rescued")).otherwise(F.lit("unrescued"))
    )
    rows = rows.select(*kept, "__raw_size", "__n", status.alias("status"), best.alias("__best"))
    gaps = F.when(F.col("__raw_size") > F.col("__n"), F.lit("gap_normalized_")).otherwise(F.lit(""))
    trim = lambda side: F.when(F.col("status") == "strict_pass", F.lit(0)).when(used, F.col(f"__best.{side}"))
    return rows.select(
        *kept, "status",
        F.when(F.col("status") == "rescued", F.concat(gaps, F.lit("trim"))).when(F.col("status") == "strict_pass", F.concat(gaps, F.lit("none"))).alias("method"),
        trim("left").alias("trim_left"), trim("right").alias("trim_right"),
        F.when(used, F.col("__n") - trim("left") - trim("right")).alias("refined_length"),
    )


def refined(df: DataFrame, key: str, seq_col: str = "s", rules: Rescue = Rescue()) -> DataFrame:
    """(key, status, sequence) of the coding sequences that pass as they are or by a trim: without gaps and trimmed."""
    kept = df.select(key, F.col(seq_col).alias("s"))
    found = rescued(kept.withColumn("__s0", F.replace(q.cleaned(F.col("s")), F.lit("-"), F.lit(""))), "s", rules)
    found = materialize(found, "rescued").where(F.col("status").isin("strict_pass", "rescued"))  # a filter before would translate again
    return found.select(key, "status", F.substr("__s0", F.col("trim_left") + 1, F.col("refined_length").cast("int")).alias("sequence"))


def reliable_counts(df: DataFrame, id_cols: list[str], seq_col: str = "s") -> DataFrame:
    """(ids, ``reliable``, ``counts`` map of codon to number) of every row; sequences whose translation isn't reliable count nothing.

    Counted in the row itself: codons are split, sorted and counted without an exchange. Null sequences aren't reliable.
    """
    s = F.coalesce(F.col(seq_col), F.lit(""))
    ok = quality(s)[-1]
    rows = df.select(*id_cols, F.coalesce(ok, F.lit(False)).alias("reliable"), s.alias("__s"))
    each = F.when(F.col("reliable"), F.filter(q.stepped(F.col("__s"), 3), lambda c: c.rlike("^[ACGT]{3}$"))).otherwise(F.array().cast("array<string>"))
    laid = rows.select(*id_cols, "reliable", F.array_sort(each).alias("__c"))
    last = lambda c: F.size(F.filter("__c", lambda x: x == c))
    counts = F.map_from_entries(F.transform(F.array_distinct("__c"), lambda c: F.struct(c, last(c))))  # 64 different codons at most
    return laid.select(*id_cols, "reliable", counts.alias("counts"))
