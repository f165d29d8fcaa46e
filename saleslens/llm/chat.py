"""Chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens place every turn: window number = tokens before the turn / stride.  So each turn is the target of
exactly one window, and windows are cut between turns only.  A window opens with the conversation's system turn, repeats as history the
turns that begin within ``history`` tokens before it, and then holds its own turns; the loss mask covers assistant
texts among the latter only, so repeated targets are masked.  With stride = (budget - history - reserve) / 2 a window keeps to
the budget if no turn is longer than the stride and the system turn fits the reserve; longer turns are never cut, their windows
are marked ``over_budget``.

A turn is written ``[INST] role [/INST]text</s>``; these marks inside texts and roles are escaped with a backslash, and
backslashes doubled, which ``read_back`` undoes.

Prefix sums are taken in two levels, chunks of turn numbers and the chunks' totals, so a conversation of any length is spread over tasks.

Defined cases: null texts and roles are empty; turns are ordered by (turn, role, text), null turn numbers first; repeated rows are separate turns; a null
conversation id is one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, RESERVE = 2048, 512, 256
#: Turn numbers per chunk of the two-level prefix sums.
CHUNK = 512
OPEN, CLOSE, END = "[INST] ", " [/INST]", "</s>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in ("[INST]", "[/INST]", "</s>"):
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def estimated_tokens(text: Column) -> Column:
    """Four characters a token, and four tokens for the marks."""
    return F.ceil(F.length(text) / 4) + 4


def windows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET,
            history: int = HISTORY, reserve: int = RESERVE, tokens: Callable[[Column], Column] = estimated_tokens) -> DataFrame:
    """(conv, span, formatted, loss_spans, n_context, n_targets, n_tokens, over_budget) per window.

    ``loss_spans`` holds (start, length) in characters of ``formatted``, start from 0; the first ``n_context`` turns are repeated ones.
    """
    stride = (budget - history - reserve) // 2
    if not 0 <= history <= stride:
        raise ValueError("history must be at most half of the budget without history and reserve")
    t = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    t = t.withColumn("tokens", tokens(F.col("text")).cast("long")).withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 55))))
    inside = Window.partitionBy("conv", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("in_tokens", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).withColumn("in_rows", F.count("*").over(inside))
    totals = rows.select(F.col(f"`{conv}`").alias("t_conv"), F.coalesce(F.floor(F.col(f"`{turn}`").cast("long") / CHUNK), F.lit(-(1 << 55))).alias("t_chunk"),
                         tokens(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long").alias("tokens")).groupBy("t_conv", "t_chunk").agg(F.sum("tokens").alias("all_tokens"), F.count("*").alias("all_rows"))
    earlier = Window.partitionBy("t_conv").orderBy("t_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("t_conv", "t_chunk", F.coalesce(F.sum("all_tokens").over(earlier), F.lit(0)).alias("off_tokens"), F.coalesce(F.sum("all_rows").over(earlier), F.lit(0)).alias("off_rows"))
    t = t.join(totals, F.col("conv").eqNullSafe(F.col("t_conv")) & (F.col("chunk") == F.col("t_chunk")))
    t = t.select("conv", "role", "tokens", (F.col("in_tokens") + F.col("off_tokens")).alias("before"), (F.col("in_rows") + F.col("off_rows")).alias("pos"),
                 F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE)).alias("head"), escape(F.col("text")).alias("body"))
    t = t.withColumn("span", F.floor(F.col("before") / stride)).withColumn("system", (F.col("pos") == 0) & (F.col("role") == "system"))

    firsts = t.groupBy(F.col("conv").alias("f_conv"), F.col("span").alias("f_span")).agg(F.min("before").alias("first"))
    piece = ["pos", "tokens", "head", "body"]
    own = t.select("conv", "span", F.lit(2).alias("kind"), *piece, (F.col("role") == "assistant").alias("loss"))
    again = (t.where("not system").join(firsts, F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("span") + 1 == F.col("f_span")))
             .where(F.col("first") - F.col("before") <= history).select("conv", F.col("f_span").alias("span"), F.lit(1).alias("kind"), *piece, F.lit(False).alias("loss")))
    systems = (t.where("system").join(firsts.where("f_span > 0"), F.col("conv").eqNullSafe(F.col("f_conv")))
               .select("conv", F.col("f_span").alias("span"), F.lit(0).alias("kind"), *piece, F.lit(False).alias("loss")))
    turns = own.unionByName(again).unionByName(systems)
    got = turns.groupBy("conv", "span").agg(
        F.sort_array(F.collect_list(F.struct("kind", "pos", "head", "body", "loss"))).alias("p"),
        F.count_if(F.col("kind") < 2).cast("int").alias("n_context"), F.count_if(F.col("kind") == 2).cast("int").alias("n_targets"), F.sum("tokens").alias("n_tokens"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def mask(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["head"])
        new = F.array(F.struct(begin.alias("start"), F.length(x["body"]).alias("length")))
        return F.struct((begin + F.length(x["body"]) + len(END)).alias("at"), F.when(x["loss"], F.concat(acc["spans"], new)).otherwise(acc["spans"]).alias("spans"))

    return got.select(F.col("conv"), "span", F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
                      F.aggregate("p", start, mask, lambda a: a["spans"]).alias("loss_spans"), "n_context", "n_targets", "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv, span, turns, losses): the own turns (role, text) of each window, and the unescaped texts under its loss mask, both read from ``formatted``."""
    pieces = F.split("formatted", F.lit(END))

    def parsed(p: Column) -> Column:
        return F.struct(unescape(F.substring(F.substring_index(p, CLOSE, 1), len(OPEN) + 1, 1 << 30)).alias("role"),
                        unescape(F.substring(p, F.instr(p, CLOSE) + len(CLOSE), F.length(p))).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv", "span", F.transform(F.slice(pieces, F.col("n_context") + 1, F.col("n_targets")), parsed).alias("turns"), masked.alias("losses"), F.length("formatted").alias("chars"))


def digests(read: DataFrame) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) per conversation.

    SHA-256 of a whole conversation needs its text in one row; nothing else gathers a conversation.
    """
    parts = read.select("conv", F.struct("span", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("text"),
                                         F.array_join("losses", "").alias("loss")).alias("part"), F.size("turns").alias("n"), "chars")
    got = parts.groupBy("conv").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    text, loss = (F.array_join(F.transform("parts", lambda p: p[name]), "") for name in ("text", "loss"))
    return got.select("conv", F.col("n_turns").cast("long"), F.sha2(text, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                      F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))
