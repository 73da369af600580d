"""Personal data: patterns propose, checksums confirm, context adjusts the score.

A span is (start, end, kind, score), code points with the end exclusive. The
four base kinds are always kept once their validator passes; the other kinds
need a score of at least ``KEEP``, which the pattern alone doesn't reach: IBAN
needs its mod-97 checksum, US social security numbers need a word nearby that
names them.

Only built-in functions. Positions come from one pattern used twice: ``split``
gives the lengths between the matches that ``regexp_extract_all`` gives, and
running sums of both are the offsets. Cheap guards keep the positions from
being computed for texts without any candidate. Unbounded repetitions are
possessive, which matches the same (nothing that follows them could take less).
A match of an address or a number can only begin where its run of characters
does, or where the last match ended, so no run is tried from each of its places.
Word ends are those of ASCII letters, digits and underscore.

Very long texts take time linear in their length: patterns pass over runs once, offsets
are gathered in blocks (``scan``), and pieces of the text are cut from chunks of
``CHUNK`` code points, never counted from its beginning.

Edge cases: null text holds nothing; matches are leftmost and non-overlapping
per kind, and spans of different kinds may overlap; a match that its validator
rejects is dropped and not tried again in part; repeated rows give repeated
results; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphstream.llm.quality import let

KEEP, NEAR = 0.6, 40
#: Code points of a chunk, and items of a block.
CHUNK, BLOCK = 1000, 64
#: Before and after a word of ASCII letters, digits and underscore, whatever the Java version's own word ends.
_FRONT, _BACK = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    parts = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves remainder 1: country and check digits go last, A is 10."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    code = lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    fold = lambda r, v: F.when(v > 9, (r * 100 + v) % 97).otherwise((r * 10 + v) % 97)
    return F.aggregate(F.transform(F.split(turned, ""), code), F.lit(0), fold) == 1


def _in_ip(value: Column) -> Column:
    return F.forall(F.split(value, "\\."), lambda p: F.coalesce(p.try_cast("long") <= 255, F.lit(False)))


def _count_between(value: Column, least: int, most: int) -> Column:
    return F.length(digits_of(value)).between(least, most)


@dataclass(frozen=True)
class Kind:
    """``valid`` drops matches, ``checked`` and ``context`` raise the score."""

    name: str
    pattern: str
    guard: str
    score: float
    context: str

    def valid(self, value: Column) -> Column:
        match self.name:
            case "ip":
                return _in_ip(value)
            case "card":
                return _count_between(value, 14, 19) & luhn(digits_of(value))
            case "phone":
                return _count_between(value, 10, 15)
            case "iban":
                bare = F.translate(value, " ", "")
                return F.length(bare).between(15, 34) & mod97(bare)
        return F.lit(True)


#: Where a run may begin: at the end of the last match, or (what is added to this) where nothing of the run is before.
_AFTER = "(?:\\G|"
#: The four base patterns, in the order that ranks kinds at one start.
BASE = [
    Kind("email", f"{_AFTER}(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "[A-Za-z0-9._%+-]@[A-Za-z0-9-]++\\.[A-Za-z0-9-]", 0.8, f"(?i){_FRONT}(e-?mail|contact|write|reply)"),
    Kind("ip", f"{_AFTER}(?<![0-9]))[0-9]++(?:\\.[0-9]++)(?:\\.[0-9]++)(?:\\.[0-9]++)", "[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]", 0.6, f"(?i){_FRONT}(ip|host|server|address)"),
    Kind("card", "[0-9](?:[\\x20-]?[0-9])++", "[0-9](?:[\\x20-]?[0-9]){13,}+", 0.8, f"(?i){_FRONT}(card|visa|credit|payment)"),
    Kind("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "\\+[0-9][\\x20().0-9-]", 0.6, f"(?i){_FRONT}(phone|tel|call|mobile)"),
]
_IBAN, _SSN = "[A-Z]{2}[0-9]{2}(?:[\\x20]?[A-Z0-9]{4}){2,7}(?:[\\x20]?[A-Z0-9]{1,3})?", "[0-9]{3}-[0-9]{2}-[0-9]{4}"
MORE = [
    Kind("iban", _FRONT + _IBAN + _BACK, "[A-Z]{2}[0-9]{2}[\\x20A-Z0-9]{11}", 0.8, f"(?i){_FRONT}(iban|account|konto|bank)"),
    Kind("ssn", _FRONT + _SSN + _BACK, _SSN, 0.4, f"(?i){_FRONT}(ssn|social security)"),
]
KINDS = [*BASE, *MORE]
_EMPTY = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def scan(items: Column, carry: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The outputs, of type ``kind``, of ``step(carry, item) -> (carry, output)`` over ``items``, from left to right.

    What an aggregate holds is copied at each of its steps. So the carries at the beginnings of blocks are found first, without
    outputs; then each block gathers its own.
    """

    def blocks(all_: Column) -> Column:
        block = lambda i: F.slice(all_, i * BLOCK + 1, F.lit(BLOCK))
        last = F.greatest(F.ceil(F.size(all_) / BLOCK).cast("int"), F.lit(1)) - 1

        def begin(state: Column, i: Column) -> Column:
            after = F.aggregate(block(i), state["carry"], lambda c, x: step(c, x)[0])
            return F.struct(after.alias("carry"), F.concat(state["begins"], F.array(state["carry"])).alias("begins"))

        begins = F.aggregate(F.sequence(F.lit(0), last), F.struct(carry.alias("carry"), F.array().cast("array<int>").alias("begins")), begin, lambda s: s["begins"])

        def add(state: Column, x: Column) -> Column:
            after, out = step(state["carry"], x)
            return F.struct(after.alias("carry"), F.concat(state["out"], F.array(out)).alias("out"))

        gathered = lambda c, i: F.aggregate(block(i), F.struct(c.alias("carry"), F.array().cast(f"array<{kind}>").alias("out")), add, lambda s: s["out"])
        return F.flatten(F.transform(begins, gathered))

    return let(items, blocks)


def chunks(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` code points; empty text has none."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(cut: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive, perhaps beyond the last) of a text in :func:`chunks`."""
    first, last = F.floor(start / CHUNK).cast("int"), F.least(F.floor((end - 1) / CHUNK).cast("int"), F.size(cut) - 1)
    part = lambda i: F.substr(F.get(cut, i), F.greatest(start - i * CHUNK, F.lit(0)) + 1, F.least(end - i * CHUNK, F.lit(CHUNK)) - F.greatest(start - i * CHUNK, F.lit(0)))
    return F.when((end > start) & (last >= first), F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), part), "")).otherwise(F.lit(""))


def _places(text: Column, pattern: str) -> Column:
    """(start, end, value) of every match, by running sums of lengths."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), gaps.alias("gap"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        end = start + F.coalesce(F.length(x["value"]), F.lit(0))
        return end, F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))

    found = scan(pairs, F.lit(0), "struct<start:int,end:int,value:string>", step)
    return F.filter(found, lambda m: m["value"].isNotNull())  # after the last match is a gap only


def _spans_of_kind(text: Column, rank: int, kind: Kind) -> Column:
    def scored(cut: Column, m: Column) -> Column:
        around = F.concat(piece(cut, F.greatest(m["start"] - NEAR, F.lit(0)), m["start"]), F.lit(" "), piece(cut, m["end"], m["end"] + NEAR))
        score = F.when(around.rlike(kind.context), F.lit(round(kind.score + 0.2, 2))).otherwise(F.lit(kind.score))
        return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))

    found = F.filter(_places(text, kind.pattern), lambda m: kind.valid(m["value"]))
    kept = let(chunks(text), lambda cut: F.transform(found, lambda m: scored(cut, m)))
    if kind.score < KEEP:
        kept = F.filter(kept, lambda s: s["score"] >= KEEP)
    return F.when(text.rlike(kind.guard), kept.cast(_EMPTY)).otherwise(F.array().cast(_EMPTY))


def spans(text: Column) -> Column:
    """All spans of a text by start, then kind; null text has none."""
    whole = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*(_spans_of_kind(whole, i, k) for i, k in enumerate(KINDS))))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and its ``spans``: array of (start, rank, end, kind, score)."""
    return df.select(F.col(id_col), spans(F.col(text_col)).alias("spans"))


def listed(found: Column, kinds: list[Kind]) -> Column:
    """kind:start:end, comma-joined, of the spans of these kinds."""
    names = [k.name for k in kinds]
    own = F.filter(found, lambda s: s["kind"].isin(names))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column) -> Column:
    """The text with ``[KIND]`` for every span; overlapping spans become one, named by the first."""

    def rebuild(cut: Column, found: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            new = F.concat(piece(cut, at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.greatest(at, s["end"]), F.when(s["start"] >= at, new).otherwise(F.lit(""))

        last = F.array_max(F.transform(found, lambda s: s["end"]))
        return F.concat(F.array_join(scan(found, F.lit(0), "string", step), ""), piece(cut, last, F.length(text)))

    return let(spans(text), lambda found: F.when(F.size(found) == 0, text).otherwise(let(chunks(text), lambda cut: rebuild(cut, found))))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Every column, the text redacted; null text stays null."""
    return df.withColumn(text_col, redacted(F.col(text_col)))


_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: case when i % 2 = 0 and c::int > 4 then 2 * c::int - 9
  when i % 2 = 0 then 2 * c::int else c::int end)) % 10 = 0"""
_BARE = "replace(value, ' ', '')"
_MOD97 = f"""list_reduce(list_transform(string_split(substr({_BARE}, 5) || substr({_BARE}, 1, 4), ''),
  lambda c: (case when c <= '9' then ascii(c) - 48 else ascii(c) - 55 end)::bigint), lambda r, v: (r * case when v > 9 then 100 else 10 end + v) % 97) % 97 = 1"""
#: The kinds' patterns and validators in DuckDB's terms, where word ends are ASCII's.
_SQL_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(value, '.'), lambda p: coalesce(try_cast(p as bigint) <= 255, false))) = 4"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) between 14 and 19 and {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 10 and 15"),
    ("iban", r"\b" + _IBAN + r"\b", f"length({_BARE}) between 15 and 34 and {_MOD97}"),
    ("ssn", rf"\b{_SSN}\b", r"""regexp_matches(substr(text, greatest(start - 40, 0) + 1, start - greatest(start - 40, 0)) || ' ' || substr(text, stop + 1, 40), '(?i)\b(ssn|social security)')"""),
]
_SQL_FOUND = " union all ".join(
    f"""select doc_id, {i} as rank, '{kind}' as kind, text, start, stop from (
  select doc_id, text, v[i] as value, (list_sum(g[1:i]) + coalesce(list_sum(n[1:i - 1]), 0))::bigint as start, (list_sum(g[1:i]) + list_sum(n[1:i]))::bigint as stop from (
    select *, unnest(range(1, len(v) + 1)) as i from (
      select doc_id, text, v, list_transform(v, lambda x: length(x)) as n, list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) as g from (
        select doc_id, text, regexp_extract_all(text, '{pattern}') as v from d))))
where {valid}"""
    for i, (kind, pattern, valid) in enumerate(_SQL_KINDS)
)
#: The same rows by DuckDB, for ids that are unique.
SQL = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
f as ({_SQL_FOUND}),
s as (
  select doc_id, {", ".join(f"count(*) filter (kind = '{k.name}') as n_{k.name}" for k in BASE)},
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < {len(BASE)}) as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans
  from f group by doc_id
)
select d.doc_id, {", ".join(f"coalesce(n_{k.name}, 0)::bigint as n_{k.name}" for k in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join s on d.doc_id = s.doc_id
"""
