"""Chat formatting in budgeted windows.

Turns are packed into windows of at most ``budget`` tokens, always whole turns:
a window starts with the conversation's system turn, repeats a limited history
of the turns before it, and then holds new turns. Each assistant turn is a
target in exactly one window; where it is repeated as history it is masked.
What is repeated gives way to what is new: history as it exceeds the room that
the new turns leave, then the system turn. Only a turn that is longer than the
budget by itself makes a window longer than it, and has that window to itself.
Tokens are counted as words plus the template's own marks; another count can be
given as an expression, or as a column of counts made before (by ``bpe.encode``, say).

Template: ``[turn ROLE]TEXT[/turn]``. In roles and texts a backslash is written
``\\b``, an opening bracket ``\\o`` and a closing one ``\\c``, so none can hold a mark or
end one, and reading back is exact.

A conversation is cut into blocks of ``block`` rows by the exact rank of its rows, and windows don't
cross blocks, so no row of the result holds more than a block and a conversation with a third
of all rows, whatever its turn numbers, spreads over many tasks. Only the system turn and the last turns of
the block before are joined to a block. Within a block, windows are chosen from
prefix sums of the turns' tokens.

Edge cases: null text and null role are empty; rows without conv_id form one
conversation; rows without turn come first; ties in turn are ordered by role,
then text, and repeated rows all stay; very long texts stay whole; extra columns are ignored; an empty table gives an
empty table. The system turn is the conversation's first row, if its role is
``system``. ``read_back`` brings each conversation together in one row, as what it returns asks:
a conversation is at most what one row can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphstream.llm.quality import let, words_of
from glyphstream.runtime import ranked

OPEN, SHUT, END = "[turn ", "]", "[/turn]"
BUDGET, HISTORY, BLOCK = 2048, 256, 256
MARK_TOKENS = 2
#: Control strings and how texts write them, the backslash first.
_CODES = [("\\", "\\b"), ("[", "\\o"), ("]", "\\c")]
_TURN = "struct<turn:bigint,role:string,text:string,tokens:bigint>"


def escaped(text: Column) -> Column:
    for plain, code in _CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(_CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def word_tokens(text: Column) -> Column:
    return F.size(words_of(text))


def _windows(turns: Column, room: Column) -> Column:
    """[first, last) turn indexes of each window: new turns while their prefix sum fits the room."""
    none = F.array().cast("array<struct<first:int,last:int>>")

    def step(s: Column, t: Column) -> Column:
        fits = (s["used"] + t["tokens"] <= room) | (s["first"] == s["at"])
        shut = F.concat(s["out"], F.array(F.struct(s["first"].alias("first"), s["at"].alias("last"))))
        grown = F.struct((s["at"] + 1).alias("at"), s["first"].alias("first"), (s["used"] + t["tokens"]).alias("used"), s["out"].alias("out"))
        fresh = F.struct((s["at"] + 1).alias("at"), s["at"].alias("first"), t["tokens"].alias("used"), shut.alias("out"))
        return F.when(fits, grown).otherwise(fresh)

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).cast("long").alias("used"), none.alias("out"))
    last = lambda s: F.concat(s["out"], F.array(F.struct(s["first"].alias("first"), s["at"].alias("last"))))
    return F.aggregate(turns, start, step, last)


def _tail(turns: Column, room: Column) -> Column:
    """The longest run of last turns whose tokens fit the room."""
    none = F.array().cast(f"array<{_TURN}>")

    def step(s: Column, t: Column) -> Column:
        fits = s["go"] & (s["used"] + t["tokens"] <= room)
        more = F.struct(F.lit(True).alias("go"), (s["used"] + t["tokens"]).alias("used"), F.concat(F.array(t), s["out"]).alias("out"))
        stop = F.struct(F.lit(False).alias("go"), s["used"].alias("used"), s["out"].alias("out"))
        return F.when(fits, more).otherwise(stop)

    start = F.struct(F.lit(True).alias("go"), F.lit(0).cast("long").alias("used"), none.alias("out"))
    return F.aggregate(F.reverse(turns), start, step, lambda s: s["out"])


def _tokens(turns: Column) -> Column:
    return F.aggregate(F.transform(turns, lambda t: t["tokens"]), F.lit(0).cast("long"), lambda a, b: a + b)


def _formatted(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(turn["role"]), F.lit(SHUT), escaped(turn["text"]), F.lit(END))


def windows(
    df: DataFrame, budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK, tokens=word_tokens,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per window: conv_id, block, window (in its block), n_repeated, n_tokens, text, loss_spans.

    ``n_repeated`` counts the leading turns of the text that other windows hold
    as their own (system turn and history). ``loss_spans`` are (start, end) in
    code points of the window's text.
    """
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col), F.lit(""))
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), (tokens(text) + MARK_TOKENS).cast("long").alias("tokens"))
    rows = ranked(rows, ["turn", "role", "text"], ["conv"])
    own = F.struct(F.col("rank").alias("turn"), "role", "text", "tokens")
    rows = rows.select("conv", F.floor(F.col("rank") / block).cast("long").alias("block"), own.alias("own"))
    blocks = rows.groupBy("conv", "block").agg(F.array_sort(F.collect_list("own")).alias("turns"))
    heads = rows.where("own.turn = 0 and own.role = 'system'").select(F.col("conv").alias("c"), F.col("own").alias("head"))
    tails = blocks.select(F.col("conv").alias("tc"), (F.col("block") + 1).alias("tb"), _tail(F.col("turns"), F.lit(history)).alias("tail"))
    joined = blocks.join(heads, F.col("conv").eqNullSafe(F.col("c")), "left").join(
        tails, F.col("conv").eqNullSafe(F.col("tc")) & (F.col("block") == F.col("tb")), "left"
    )
    none = F.array().cast(f"array<{_TURN}>")
    room = F.greatest(F.lit(budget - history) - F.coalesce(F.col("head.tokens"), F.lit(0)), F.lit(0))
    joined = joined.select("conv", "block", "head", "turns", F.coalesce("tail", none).alias("tail"), _windows(F.col("turns"), room).alias("spans"))
    each = joined.select("conv", "block", "head", "turns", "tail", F.posexplode("spans").alias("window", "span"))
    fresh = F.slice("turns", F.col("span.first") + 1, F.col("span.last") - F.col("span.first"))
    before = F.when(F.col("window") == 0, F.col("tail")).otherwise(F.slice("turns", F.lit(1), F.col("span.first")))
    each = each.select("conv", "block", "window", "head", fresh.alias("new"), before.alias("before"), (F.lit(budget) - _tokens(fresh)).alias("left"))
    starts = (F.col("block") == 0) & (F.col("window") == 0)
    system = F.when(F.col("head").isNull() | starts | (F.col("head.tokens") > F.col("left")), none).otherwise(F.array("head"))
    each = each.select("conv", "block", "window", "new", "before", system.alias("system"), (F.col("left") - _tokens(system)).alias("left"))
    past = F.filter(_tail(F.col("before"), F.least(F.lit(history).cast("long"), F.col("left"))), lambda t: (t["turn"] != 0) | (F.size("system") == 0))
    laid = each.select("conv", "block", "window", F.concat("system", past).alias("old"), "new")
    laid = laid.select(
        "conv", "block", "window", F.size("old").alias("n_repeated"), _tokens(F.concat("old", "new")).alias("n_tokens"),
        F.transform("old", _formatted).alias("old"), F.transform("new", _formatted).alias("shown"), "new",
    )
    spans = let(
        F.transform("shown", F.length),
        lambda sizes: F.filter(
            F.transform("new", lambda t, i: _span(t, i, sizes, F.length(F.array_join("old", "")))), lambda s: s.isNotNull()
        ),
    )
    return laid.select(
        F.col("conv").alias(conv_col), "block", "window", "n_repeated", "n_tokens",
        F.array_join(F.concat("old", "shown"), "").alias("text"), spans.alias("loss_spans"),
    )


def _span(turn: Column, i: Column, sizes: Column, before: Column) -> Column:
    """(start, end) of an assistant turn's own text in the window's text."""
    ahead = F.aggregate(F.slice(sizes, F.lit(1), i), before, lambda a, b: a + b)
    start = ahead + len(OPEN) + F.length(escaped(turn["role"])) + len(SHUT)
    end = ahead + F.get(sizes, i) - len(END)
    return F.when(turn["role"] == "assistant", F.struct(start.alias("start"), end.alias("end")))


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, from window texts and masks alone: ``turns`` (role, text) in order, the
    ``loss`` text, and ``formatted_chars``."""
    marks = F.filter(F.split("text", "\\[/turn\\]"), lambda x: x != "")
    own = F.slice(marks, F.col("n_repeated") + 1, F.size(marks))
    cut = lambda x: F.struct(
        unescaped(F.substr(F.substring_index(x, SHUT, 1), F.lit(len(OPEN) + 1))).alias("role"),
        unescaped(F.substr(x, F.length(F.substring_index(x, SHUT, 1)) + 2)).alias("text"),
    )
    loss = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    parts = formatted.select(
        F.col(conv_col), "block", "window", F.transform(own, cut).alias("turns"), F.array_join(loss, "").alias("loss"), F.length("text").cast("long").alias("chars"),
    )
    whole = parts.groupBy(conv_col).agg(
        F.array_sort(F.collect_list(F.struct("block", "window", "turns", "loss"))).alias("parts"), F.sum("chars").alias("formatted_chars")
    )
    return whole.select(
        conv_col,
        F.flatten(F.transform("parts", lambda p: p["turns"])).alias("turns"),
        F.array_join(F.transform("parts", lambda p: p["loss"]), "").alias("loss"),
        "formatted_chars",
    )
