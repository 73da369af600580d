"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document; the ledger stores the measurements
and one bit for each rule that failed. A policy is a versioned mask of rules, so
its verdict is one bitwise test, and what a rule costs (its ablation) is counted
from the few distinct masks without reading a text again.

Only built-in functions: per document, arrays of words and of 8-word window
hashes are made inside one row, and windows that occur twice are found by
sorting the hashes, so no row ever leaves its partition.

Words are runs of characters other than space and tab to carriage return.

Edge cases: null text has no words; an empty text likewise, so both fail the
rule on too few words and no other; very long texts take O(n log n); repeated
rows are judged alike; extra columns are ignored; an empty table gives an empty
ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space between words, and the characters counted as symbols.
SPACE, SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "[\\x20\\x09-\\x0D]+", "#*$%&|<>"
WINDOW = 8

#: Bit number to (name, failure condition over the measurements).
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("too_many_words", "n_words > 100000"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Version to mask: the rules that a policy enforces.
POLICIES = {
    "base": BITS["too_few_words"] | BITS["repeated_words"],
    "v1": sum(BITS.values()),
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice: the union of [p, p + 8) over those windows."""

    def union(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def twice(pairs: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        hit = F.filter(pairs, lambda x, i: same(x, F.get(pairs, i - 1)) | same(x, F.get(pairs, i + 1)))
        return let(F.array_sort(F.transform(hit, lambda x: x["p"])), union)

    return let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), twice)


def repeated_words(words: Column) -> Column:
    """Words in 8-word windows found twice or more in the text, the first included."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(words, lambda w: let(windows(w), count)))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the measurements of every whole text, one pass."""
    text = F.col("__text")
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.withColumn("__words", words_of(text))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    rows = rows.withColumn("__lines", lines)
    return rows.select(
        id_col,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).cast("long").alias("n_repeat_words"),
    )


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``failures``: bit i is set where rule i fails."""
    bits = F.lit(0).cast("long")
    for i, (_, failed) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(df, id_col, text_col).withColumn("failures", bits)


def passes(policy: str) -> Column:
    """Whether a ledger row has no failure that the policy enforces."""
    return F.col("failures").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(rows: DataFrame) -> DataFrame:
    """Per policy and rule of it: documents kept, kept without the rule, and failed by it alone."""
    masks = rows.groupBy("failures").agg(F.count("*").alias("n"))
    cases = [(p, name, mask, BITS[name]) for p, mask in POLICIES.items() for name in BITS if mask & BITS[name]]
    literal = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for p, r, m, b in cases))
    each = masks.select("failures", "n", F.inline(literal))
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    others = hit.bitwiseAND(F.bitwise_not("bit"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return each.groupBy("policy", "rule").agg(
        total(hit == 0).alias("n_kept"), total(others == 0).alias("n_kept_without"), total(hit == F.col("bit")).alias("n_failed_alone"),
        F.bit_or(hit).alias("failures_seen"),
    )


#: The same rows by DuckDB.
SQL = """
with d as (
  select doc_id, coalesce(text, '') as text from documents
), w as (
  select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from d
), g as (
  select doc_id, unnest(range(1, len(words) - 6)) as p, words from w where len(words) >= 8
), h as (
  select doc_id, p, array_to_string(words[p : p + 7], ' ') as g from g
), twice as (
  select doc_id, p from h qualify count(*) over (partition by doc_id, g) > 1
), cover as (
  select doc_id, count(distinct q) as n from (select doc_id, p + unnest(range(0, 8)) as q from twice) group by doc_id
), m as (
  select w.doc_id, len(words)::bigint as n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         len(lines)::bigint as n_lines,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(cover.n, 0)::bigint as n_repeat_words
  from w left join cover on w.doc_id = cover.doc_id
), f as (
  select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
    (case when n_words < 20 then 1 else 0 end) + (case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end)
    + (case when 100 * n_symbols > 30 * n_words then 4 else 0 end) + (case when 100 * n_dup_lines > 30 * n_lines then 8 else 0 end)
    + (case when word_chars < 2 * n_words then 16 else 0 end) + (case when word_chars > 20 * n_words then 32 else 0 end)
    + (case when n_words > 100000 then 64 else 0 end) as failures
  from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failures = 0 as kept, failures::bigint as failures
from f
"""
