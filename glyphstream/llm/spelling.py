"""Spelling variant grouping by a rare-first prefix filter on positional bigrams.

Two words one edit apart share all bigrams but the two at most that the edit touches. Bigrams are put into one order over all words,
rarest first; of each word only the three rarest are joined, so at least one of them is a bigram the edit doesn't touch. A replaced
code point leaves it at its place, an inserted one moves it by one at most, so the join is on bigram, length and place. Candidates
are verified by their edit distance.

Three are enough though bigrams repeat: places of one bigram are ordered from the left, and an edit keeps the order of the bigrams it doesn't
touch. Were the first such of either word not among the other's three, each would come before the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphstream.runtime import broadcast_if_small, materialize, skew_join

RUN = "[A-Za-z\\x{00C0}-\\x{00FF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One edit touches two bigrams; with three, one is left.
RAREST = 3
#: Postings of one bigram, length and place that one task compares with each other; more are dealt out in parts of this size.
BUCKET = 2_000


def _lower(run: Column) -> Column:
    """A-Z in lower case and nothing else; runs of one byte a code point take the fast way."""
    return F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def damaged(doc: Column, run: Column, of: int = 97) -> Column:
    """``run`` without the code point h % length where ``of`` divides h, the crc32 of ``<doc>:<run>``. Where ``doc`` is null it stays whole."""
    h = F.crc32(F.concat(doc.cast("string"), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % of == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = 5, least: int = 3) -> DataFrame:
    """(``word``, ``n``): distinct damaged runs of whole texts, of ``length`` code points and ``least`` occurrences at least.

    Null and empty texts have no words; rows that share an id and repeated rows count each; other columns are dropped. Counts are
    added up before they are exchanged, so a frequent word is a row a task.
    """
    runs = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.where(F.length("run") >= length).select("doc", _lower(F.col("run")).alias("run")).select(damaged(F.col("doc"), F.col("run")).alias("word"))
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def postings(words: DataFrame) -> DataFrame:
    """(``id``, ``gram``, ``place``): the rarest bigrams of each word (``id``, ``word``) and their places.

    Only ids go with the bigrams, so a very long word costs what it is long.
    """
    letters = words.where(F.length("word") > RAREST).select("id", F.split("word", "").alias("letters"))
    grams = F.transform(F.sequence(F.lit(0), F.size("letters") - 2), lambda i: F.concat(F.get("letters", i), F.get("letters", i + 1)))
    placed = letters.select("id", F.posexplode(grams).alias("place", "gram"))
    counts = placed.groupBy("gram").agg(F.count("*").alias("common"))  # a row for each pair of letters
    ranked = placed.join(broadcast_if_small(counts), "gram").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("common", "gram", "place"))).alias("all"))
    return ranked.select("id", F.inline(F.slice("all", 1, RAREST))).select("id", "gram", "place")


def _mask(word: Column) -> Column:
    """A bit for each hashed bigram: an edit removes two at most and brings two at most."""
    bit = lambda pair: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(pair), F.lit(64)).cast("int"))
    step = lambda s, x: F.struct(s["mask"].bitwiseOR(F.when(s["last"] == "", F.lit(0).cast("long")).otherwise(bit(F.concat(s["last"], x)))).alias("mask"), x.alias("last"))
    return F.aggregate(F.split(word, ""), F.struct(F.lit(0).cast("long").alias("mask"), F.lit("").alias("last")), step, lambda s: s["mask"])


def links(words: DataFrame) -> DataFrame:
    """(``word``, ``n``, ``near``, ``near_n``): all pairs one edit apart, both ways.

    A posting looks for words of its own length at its own place, and for words longer by one at its own and the next. What many
    words have is cut into parts of ``BUCKET`` postings: one side is dealt out, the other goes to every part.
    """
    key = ["gram", "size", "place"]
    words = materialize(words.withColumn("id", F.monotonically_increasing_id()), "words")
    seen = words.select("id", "word", "n", F.length("word").alias("size"), _mask(F.col("word")).alias("mask"))
    held = materialize(postings(words).join(seen, "id").drop("id"), "postings")
    sizes = held.groupBy(*key).agg(F.count("*").alias("__of"))
    large = sizes.where(F.col("__of") > BUCKET).select(*key, F.ceil(F.col("__of") / BUCKET).cast("int").alias("__parts"))
    large = broadcast_if_small(materialize(large, "buckets"))  # one row for BUCKET postings at most
    longer = lambda by: held.select("word", "n", "mask", "gram", (F.col("size") + 1).alias("size"), (F.col("place") + by).alias("place"), F.lit(True).alias("shorter"))
    seek = held.select("word", "n", "mask", *key, F.lit(False).alias("shorter")).unionByName(longer(0)).unionByName(longer(1))
    seek = seek.join(large, key, "left").withColumn("part", F.pmod(F.xxhash64("word"), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    every = F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)
    found = held.join(large, key, "left").select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("mask").alias("near_mask"), *key, F.explode(every).alias("part"))
    same = [F.col(f"s.{c}") == F.col(f"f.{c}") for c in (*key, "part")]
    # the edit distance is part of the join: what isn't near never becomes a row
    apart = F.bit_count(F.col("mask").bitwiseXOR(F.col("near_mask")))
    near = (F.col("shorter") | (F.col("word") < F.col("near"))) & (apart <= 4) & (F.levenshtein("word", "near", 1) == 1)
    pair = lambda a, an, b, bn: F.struct(F.col(a).alias("word"), F.col(an).alias("n"), F.col(b).alias("near"), F.col(bn).alias("near_n"))
    both = F.array(pair("word", "n", "near", "near_n"), pair("near", "near_n", "word", "n"))
    return seek.alias("s").join(found.alias("f"), [*same, near]).select(F.inline(both)).distinct()


def variants(words: DataFrame) -> DataFrame:
    """All ``words`` (``word`` once each, ``n``) with ``n_near``, ``form``, ``form_n`` and ``root``.

    ``form`` is the near word of largest n, of equal ones the smallest in code-point order, if its n is twice the word's or more; ``root``
    is the last of the forms, the word itself if there is none. Words under four code points have too few bigrams for the filter and are near none;
    longer ones take part whatever their length; a null word is dropped; no words give no rows.
    """
    words = materialize(words.where(F.col("word").isNotNull()).select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    told = links(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = words.join(told, "word", "left")
    enough = -F.col("best.less") >= 2 * F.col("n")
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    rows = materialize(rows, "forms")
    # n doubles at least with each step, so chains are short; the distance followed doubles with each round
    linked = rows.select("word", F.coalesce("form", "word").alias("root"))
    moved = True
    while moved:
        ahead = linked.select(F.col("word").alias("root"), F.col("root").alias("__further"))
        further = skew_join(linked, ahead, ["root"])
        linked = materialize(further.select("word", F.col("__further").alias("root"), (F.col("root") != F.col("__further")).alias("__moved")), "roots")
        moved = linked.where("__moved").limit(1).count() > 0
        linked = linked.select("word", "root")
    return rows.join(linked, "word").select("word", "form", "root", "n", "n_near", "form_n")


#: The same rows in DuckDB: words are near if they are equal without one code point at one place, or one is the other without one.
SQL = """
with crc_table as (
  select list_transform(range(256), lambda i: list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents
), counted as (
  select doc_id, run, count(*) as c from runs where length(run) >= 5 group by all
), hashed as (
  select run, c, xor(list_reduce([4294967295::bigint] || flatten(list_transform(string_split(doc_id::varchar || ':' || run, ''),
    lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end)), lambda s, b: xor(s >> 8, t[xor(s & 255, b) + 1])), 4294967295) as h
  from counted, crc_table where doc_id is not null
  union all select run, c, 1 from counted where doc_id is null
), v as (
  select word, sum(c)::bigint as n from (
    select c, case when h % 97 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed
  ) where length(word) >= 5 group by 1 having sum(c) >= 3
), holes as (
  select word, n, i, left(word, i) || substr(word, i + 2) as x from (select word, n, unnest(range(length(word))) as i from v)
), near as (
  select a.word, a.n, b.word as near, b.n as near_n from holes a join holes b on a.x = b.x and a.i = b.i and a.word <> b.word
  union
  select a.word, a.n, b.word, b.n from holes a join v b on a.x = b.word
  union
  select b.word, b.n, a.word, a.n from holes a join v b on a.x = b.word
), best as (
  select word, count(*) as n_near, min((-near_n, near)) as b from near group by 1
), forms as (
  select word, n, coalesce(n_near, 0) as n_near, case when -b[1] >= 2 * n then b[2] end as form, case when -b[1] >= 2 * n then -b[1] end as form_n
  from v left join best using (word)
), steps as (
  with recursive walk as (
    select word, word as root, 0 as far from forms
    union all
    select w.word, f.form, far + 1 from walk w join forms f on f.word = w.root where f.form is not null
  ) select word, arg_max(root, far) as root from walk group by 1
)
select word, form, root, n, n_near, form_n from forms join steps using (word)
"""
