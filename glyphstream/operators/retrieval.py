"""Lexical retrieval over guide chunks, and the guard of exported tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphstream.functions import text as t
from glyphstream.runtime import BROADCAST_ROWS, broadcast_if_small, many_join, materialize


#: A header line and a line of symbols below it.
FASTA_LIKE = "(?m)^>[^\\n]*\\n[ACGTUN]{4}"


def expanded(terms: Column, aliases: dict[str, list[str]]) -> Column:
    """Query terms and their aliases, distinct."""
    more = [F.when(F.array_contains(terms, k), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in aliases.items()]
    return F.array_distinct(F.concat(terms, *more)) if more else F.array_distinct(terms)


def postings(chunks: DataFrame) -> DataFrame:
    """The inverted index of chunks (id, title, section, tags, text): (``term``, ``id``, ``weight``), one row a chunk and term.

    A term met anywhere in a chunk weighs 1, in its title or section 3 more, among its tags 4 more. Each text is folded once;
    no rows are exchanged. Null fields have no terms; rows that share an id have postings each.
    """
    title, tags = F.concat_ws(" ", "title", "section"), F.array_join("tags", " ")
    told = chunks.select("id", t.terms(title).alias("in_title"), t.terms(tags).alias("in_tags"), t.terms(F.coalesce("text", F.lit(""))).alias("in_text"))
    told = told.withColumn("in_tags", F.coalesce("in_tags", F.array().cast("array<string>")))
    rows = told.select("id", "in_title", "in_tags", F.explode(F.array_distinct(F.concat("in_title", "in_tags", "in_text"))).alias("term"))
    held = lambda field: F.array_contains(field, F.col("term")).cast("long")
    return rows.select("term", "id", (1 + 3 * held("in_title") + 4 * held("in_tags")).alias("weight"))


def index(chunks: DataFrame) -> DataFrame:
    """The postings stored in order of their terms, for any number of questions; a term's rows lie together in few files."""
    return materialize(postings(chunks).repartitionByRange("term", "id").sortWithinPartitions("term", "id"), "postings")


def asked(questions: DataFrame) -> DataFrame:
    """(``question``, ``term``) of questions (question, text): terms and their aliases. Texts under four characters ask nothing; null neither."""
    real = questions.where(F.length(F.trim("text")) >= 4)
    told = real.select("question", t.terms(F.col("text")).alias("own"))
    return told.select("question", F.explode(expanded(F.col("own"), t.ALIASES)).alias("term"))


def answers(held: DataFrame, chunks: DataFrame, questions: DataFrame, top: int = 4) -> DataFrame:
    """(``question``, ``rank``, ``id``, ``score``): the top chunks of each question with a positive score, by score, ties by id.

    A question that no chunk meets gets the first chunks by id, with score 0; one under four characters gets none. ``held`` are postings, stored
    or as they are made: few terms are sent to where postings are, so those of other terms go no further than their task, and
    many are joined by term, a frequent one in parts. Weights are added up before the exchange, and no task ranks more than ``top`` chunks of a part.
    """
    wanted = materialize(asked(questions), "asked")
    few = wanted.count() <= BROADCAST_ROWS
    each = held.join(F.broadcast(wanted), "term") if few else many_join(held, wanted, ["term"])
    met = each.groupBy("question", "id").agg(F.sum("weight").alias("score"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
    best = materialize(met.withColumn("rank", place).where(F.col("rank") <= top).select("question", "rank", "id", "score"), "best")
    first = [r["id"] for r in chunks.select("id").orderBy("id").limit(top).collect()]
    none = questions.where(F.length(F.trim("text")) >= 4).select("question").distinct().join(best.select("question").distinct(), "question", "left_anti")
    if not first:
        return best
    listed = F.posexplode(F.array(*(F.lit(i) for i in first))).alias("rank", "id")
    rest = none.select("question", listed).select("question", (F.col("rank") + 1).alias("rank"), F.col("id").cast(best.schema["id"].dataType), F.lit(0).cast("long").alias("score"))
    return best.unionByName(rest)


def scored(chunks: DataFrame, question: str) -> DataFrame:
    """Chunks with their ``score`` for one question, 0 where no term meets; postings of other terms go no further than their task."""
    one = chunks.sparkSession.range(1).select(F.lit(0).alias("question"), F.lit(question).alias("text"))
    wanted = [r["term"] for r in asked(one).collect()]  # one question's terms
    met = postings(chunks).where(F.col("term").isin(wanted)).groupBy("id").agg(F.sum("weight").alias("score"))
    return chunks.join(met, "id", "left").withColumn("score", F.coalesce("score", F.lit(0)))


def answer(chunks: DataFrame, question: str, top: int = 4) -> DataFrame:
    """The top chunks with a positive score, by score, ties by id; the first ones by id if none scores."""
    best = scored(chunks, question).orderBy(F.desc("score"), "id").limit(top)
    best = best.withColumn("__most", F.max("score").over(Window.partitionBy(F.lit(1))))  # over ``top`` rows
    return best.where("score > 0 or __most = 0").drop("__most").orderBy(F.desc("score"), "id")


def replies(chunks: DataFrame, questions: DataFrame, found: DataFrame) -> DataFrame:
    """(``question``, ``in_scope``, ``opening``, ``citations``, ``topics``, ``view``) for each answered question of ``found`` (as of :func:`answers`).

    A question that asks for claims is out of scope and has no opening, others open with the first sentence of their best chunk; citations name
    the chunks in order, topics are the first eight of their tags, the view is the one they point to.
    """
    named = chunks.select("id", "title", "section", "tags", "text").join(broadcast_if_small(found.select("id").distinct()), "id", "left_semi")
    named = named.select("id", "title", "section", "tags", t.first_sentence(F.col("text")).alias("says"))
    rows = found.join(named, "id").groupBy("question").agg(F.sort_array(F.collect_list(F.struct("rank", "title", "section", "tags", "says"))).alias("top"))
    claims = questions.select("question", t.mentions(F.col("text")).alias("claims"))
    topics = F.array_distinct(F.flatten(F.col("top.tags")))
    cite = F.transform("top", lambda r: F.format_string("[%d] %s (%s)", r["rank"], r["title"], r["section"]))
    told = rows.join(claims, "question")
    return told.select(
        "question", (~F.col("claims")).alias("in_scope"), F.when(~F.col("claims"), F.get("top.says", F.lit(0))).alias("opening"),
        F.array_join(cite, "; ").alias("citations"), F.array_join(F.slice(topics, 1, 8), ",").alias("topics"), view_hint(topics).alias("view"),
    )


#: The view that each tag, in this order, points to.
VIEWS = [
    (["structure"], "structure"), (["antigenlm"], "latent"), (["dataset"], "atlas"), (["tokenization", "sequence_context"], "tokens"),
    (["representation"], "projector"),
]


def view_hint(tags: Column) -> Column:
    """The view that the first of the tags, by their rank, points to; else the guide."""
    out = F
    for names, view in VIEWS:
        out = out.when(F.arrays_overlap(tags, F.array(*map(F.lit, names))), F.lit(view))
    return out.otherwise(F.lit("guide"))


def require_short_tokens(df: DataFrame, column: str = "token", longest: int = 6) -> DataFrame:
    """``df`` itself, or an error if it exports tokens longer than six symbols."""
    if (most := df.agg(F.max(F.length(column))).first()[0] or 0) > longest:
        raise ValueError(f"tokens of {most} symbols in an export")
    return df


def guard(df: DataFrame, forbidden: set[str], longest: int = 80) -> DataFrame:
    """(column, long_runs, fasta_like): strings of an export that hold a long symbol run or a FASTA header.

    Raises at once if a forbidden column is present; nested values are seen as their JSON.
    """
    if leaked := sorted(forbidden & set(df.columns)):
        raise ValueError(f"forbidden columns in an export: {leaked}")
    sums = guard_sums(df, longest)
    if not sums:
        return df.sparkSession.createDataFrame([], "column string, long_runs long, fasta_like long")
    one = df.agg(*(s.alias(label) for label, s in sums.items()))
    strings = dict.fromkeys(label.rsplit("__", 1)[0] for label in sums)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}__run").alias("long_runs"), F.col(f"{c}__fasta").alias("fasta_like")) for c in strings))
    return one.select(F.inline(rows))


def guard_sums(df: DataFrame, longest: int = 80) -> dict[str, Column]:
    """Aggregates that count long symbol runs (``<column>__run``) and FASTA headers (``<column>__fasta``) in every column of text; nested values as their JSON."""
    kinds = {c: kind for c, kind in df.dtypes if kind == "string" or "struct" in kind or "array" in kind or "map" in kind}
    seen = {c: F.col(c) if kind == "string" else F.to_json(F.col(c)) for c, kind in kinds.items()}
    runs = {f"{c}__run": F.count_if(x.rlike(f"[ACGTN]{{{longest},}}")) for c, x in seen.items()}
    return runs | {f"{c}__fasta": F.count_if(x.rlike(FASTA_LIKE)) for c, x in seen.items()}


def require_safe(df: DataFrame, forbidden: set[str], longest: int = 80) -> DataFrame:
    """``df`` itself, or an error if the guard finds anything."""
    if bad := guard(df, forbidden, longest).where("long_runs > 0 or fasta_like > 0").collect():
        raise ValueError(f"unsafe values in: {[r['column'] for r in bad]}")
    return df


def dominant(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n): the most frequent value of each group, ties to the smaller value."""
    sizes = df.groupBy(group, value).agg(F.count("*").alias("n"))
    place = Window.partitionBy(group).orderBy(F.desc("n"), value)
    return sizes.withColumn("__at", F.row_number().over(place)).where("__at = 1").drop("__at")
