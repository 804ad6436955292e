"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens cut a conversation into spans of whole turns. A window holds
the system turn, a limited repeat of the turns before the span, and the span itself.
Only the span's assistant texts are under the loss mask, so each counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of new turns that a window takes before the next one begins.
SPAN_TOKENS = 1024
#: Tokens of earlier turns that a window repeats at most; no more than a span's.
HISTORY_TOKENS = 256
#: Turns of a conversation that are summed together before the sums are added up.
TURNS = 512

# The template's control strings and the escape character.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>\n"
ESCAPE = "\\"


def escaped(text: Column) -> Column:
    """No control string can arise: the escape character is doubled and ``<`` before ``|`` gets one after it."""
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + ESCAPE))
    return F.replace(doubled, F.lit("<|"), F.lit("<" + ESCAPE + "|"))


def unescaped(text: Column) -> Column:
    """The exact inverse: after an escape character the next character is plain."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_tokens(text: Column) -> Column:
    """A token for every four characters begun, and one for the turn's marks. Set your own count by ``tokens``."""
    return F.ceil(F.length(text) / 4) + 1


def windows(
    conversations: DataFrame,
    *,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    span_tokens: int = SPAN_TOKENS,
    history_tokens: int = HISTORY_TOKENS,
    tokens=turn_tokens,
) -> DataFrame:
    """One row per window: conv, window (from 0), n_context, n_turns, formatted, loss.

    ``formatted`` is the window as it is trained on, ``n_context`` the number of its leading
    turns that are repeated (system turn and history), ``n_turns`` that of its own, ``loss``
    the array of (start, length) in code points of the assistant texts of its own turns.

    A turn belongs to the span in which its first token falls, so turns are never cut. A
    span holds less than ``span_tokens`` and its last turn; a turn longer than that makes a
    window as long as it is. History are the turns just before the span that begin within
    ``history_tokens`` of it, so it holds no more than that. The system turn is the
    conversation's first one, if its role is ``system``; it is not counted twice.

    Turns are ordered by turn, role and text, nulls first; repeated rows are repeated turns.
    Null texts and roles are empty. A null conv is a conversation of its own. Sums are
    taken in runs of turns first, so a long conversation is not summed in one task; a
    window is all that is ever gathered in one row.
    """
    if history_tokens > span_tokens:
        raise ValueError("history_tokens must not exceed span_tokens")
    turns = conversations.select(
        F.struct(F.col(conv).alias("id")).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    turns = turns.withColumns({"tokens": tokens(F.col("text")), "run": F.floor(F.coalesce(F.col("turn"), F.lit(0)) / TURNS), "nulls": F.col("turn").isNull()})
    # Two-level prefix sums. Null turns come before all others, as a run of their own.
    runs = turns.groupBy("conv", "nulls", "run").agg(F.sum("tokens").alias("n"), F.count("*").alias("turns"))
    earlier = Window.partitionBy("conv").orderBy(F.col("nulls").desc(), "run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv", "nulls", "run", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(to) for c, to in (("n", "tokens_before"), ("turns", "turns_before"))])
    inside = Window.partitionBy("conv", "nulls", "run").orderBy("turn", "role", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumns({"start": F.coalesce(F.sum("tokens").over(upto), F.lit(0)), "number": F.row_number().over(inside) - 1})
    turns = turns.join(runs, ["conv", "nulls", "run"])
    turns = turns.withColumns({"start": F.col("start") + F.col("tokens_before"), "number": F.col("number") + F.col("turns_before")})
    turns = turns.withColumn("span", F.floor(F.col("start") / span_tokens)).select("conv", "number", "role", "text", "start", "span")

    # Spans in order, each with where the next one begins. Long turns leave gaps in the numbers.
    spans = turns.groupBy("conv", "span").agg(F.min("start").alias("begin"))
    in_order = Window.partitionBy("conv").orderBy("span")
    spans = spans.withColumns({"window": F.row_number().over(in_order) - 1, "next_begin": F.lead("begin").over(in_order)}).drop("begin")
    placed = turns.join(spans, ["conv", "span"])
    repeats = placed.where("next_begin is not null").where(F.col("next_begin") - F.col("start") <= history_tokens)
    system = placed.where("number = 0 and role = 'system'").select("conv", F.struct("number", F.lit(False).alias("own"), "role", "text").alias("system"))

    own = placed.select("conv", "window", F.lit(True).alias("own"), "number", "role", "text")
    again = repeats.select("conv", F.col("window") + 1, F.lit(False), "number", "role", "text")
    held = own.union(again).groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct("number", "own", "role", "text"))).alias("turns"))
    held = held.join(system, "conv", "left")
    missing = F.col("system").isNotNull() & (F.col("turns")[0]["number"] > 0)
    held = held.withColumn("turns", F.when(missing, F.concat(F.array("system"), "turns")).otherwise(F.col("turns")))
    return _rendered(held).withColumn(conv, F.col("conv.id")).select(conv, "window", "n_context", "n_turns", "formatted", "loss")


def _rendered(held: DataFrame) -> DataFrame:
    """Texts joined and mask positions added up along the window's turns."""
    marked = F.transform(
        "turns",
        lambda t: F.struct(
            t["own"].alias("own"),
            (t["own"] & (t["role"] == "assistant")).alias("target"),
            F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(MIDDLE)).alias("head"),
            escaped(t["text"]).alias("body"),
        ),
    )
    held = held.select("conv", "window", marked.alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    lengths = F.transform("turns", lambda t: F.struct(t["target"].alias("target"), F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body")))
    held = held.select("conv", "window", F.size(F.filter("turns", lambda t: ~t["own"])).alias("n_context"), F.size(F.filter("turns", lambda t: t["own"])).alias("n_turns"), formatted.alias("formatted"), lengths.alias("lengths"))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    mask = F.aggregate(
        "lengths",
        nothing,
        lambda acc, t: F.struct(
            (acc["at"] + t["head"] + t["body"] + len(CLOSE)).alias("at"),
            F.when(t["target"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["head"]).alias("start"), t["body"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return held.withColumn("loss", mask)


def parsed_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted window, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring_index(p, MIDDLE, 1)).alias("role"),
            unescaped(p.substr(F.length(F.substring_index(p, MIDDLE, 1)) + len(MIDDLE) + 1, F.length(p) - F.length(F.substring_index(p, MIDDLE, 1)) - len(MIDDLE) - len(CLOSE))).alias("text"),
        ),
    )


def masked_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the mask, unescaped."""
    return F.transform(loss, lambda s: unescaped(formatted.substr(s["start"] + 1, s["length"])))


def read_back(formatted: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from windows alone.

    A digest over a whole conversation needs its turns in one row, whatever its length.
    """
    own = formatted.withColumn("own", F.slice(parsed_turns(F.col("formatted")), F.col("n_context") + 1, F.col("n_turns")))
    parts = own.select(
        F.struct(F.col(conv).alias("id")).alias("conv"),
        "n_turns",
        F.length("formatted").cast("long").alias("chars"),
        F.struct(
            "window",
            F.array_join(F.transform("own", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join(masked_texts(F.col("formatted"), F.col("loss")), "").alias("loss"),
        ).alias("part"),
    )
    whole = parts.groupBy("conv").agg(F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("part")).alias("parts"))
    turns, loss = F.array_join(F.transform("parts", lambda p: p["turns"]), ""), F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return whole.select(
        F.col("conv.id").alias(conv),
        "n_turns",
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
