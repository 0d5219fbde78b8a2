"""Chat formatting in budgeted windows, with DataFrame functions only.

A window holds the system turn (where the conversation begins with one), some turns that came before, and new turns.
Prefix sums of the turns' tokens choose the new turns: the token line of a conversation is cut into strides of what
the budget leaves beside system turn and history; turns inside one stride share a window, and a turn that lies across
a cut has a window of its own. So spans end between turns and every turn is new exactly once. A window repeats as much
of the history as its new turns leave room for, so it keeps to the budget unless the system turn and one new turn
alone exceed it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUDGET = 1024
HISTORY = 256
TURN_TOKENS = 4  # what the marks of a turn count

# Fixed values of the template. Inside texts the marks' characters are written with a backslash, so none is ever a mark.
OPEN, AFTER_ROLE, CLOSE = "<turn:", ">\n", "\n</turn>\n"
ESCAPES = [("\\", "\\b"), ("<", "\\l"), (">", "\\g")]
TARGET = "assistant"


def escaped(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def estimated_tokens(text: Column) -> Column:
    """Words and single marks, without a vocabulary."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))


def format_windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_id: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text", tokens=estimated_tokens,
) -> DataFrame:
    """Training windows of conversations given as one row per turn.

    Columns: ``conv_id``, ``window`` (increasing, with gaps), ``n_system`` and ``n_history`` (turns repeated at the
    front), ``first`` (position of the first new turn, from 1), ``n_new``, ``n_tokens``, ``formatted`` and ``loss``, the
    stretches (``start`` from 0, ``length``; code points of ``formatted``) of new assistant texts. Repeated turns are
    never under the mask, so each target counts once. Turns are ordered by turn, role and text; repeated rows
    are turns of their own; null roles and texts are empty; a null ``conv_id`` is one conversation; other columns are
    not looked at; an empty table gives no rows. Only a first turn of role ``system`` is retained.

    One shuffle by conversation; nothing is gathered beyond a window. The history frame holds ``history`` tokens at most.
    """
    name = lambda c: F.col(f"`{c}`")
    t = turns.select(
        name(conv_id).alias("conv_id"), name(turn).alias("turn"),
        F.coalesce(name(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(name(text).cast("string"), F.lit("")).alias("text"),
    ).withColumn("tokens", tokens(F.col("text")).cast("long") + TURN_TOKENS)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    system = F.first(F.when(F.col("role") == "system", F.struct("role", "text", "tokens"))).over(so_far)
    t = (
        t.withColumn("position", F.row_number().over(order))
        .withColumn("until", F.sum("tokens").over(so_far))
        .withColumn("system", system)
        .withColumn("system_tokens", F.coalesce(F.col("system.tokens"), F.lit(0)))
        .withColumn("is_system", (F.col("position") == 1) & (F.col("role") == "system"))
        .withColumn("follows", F.lead(F.lit(1)).over(order).isNotNull())
        .where(~(F.col("is_system") & F.col("follows")))
    )
    begin = F.col("until") - F.col("tokens") - F.col("system_tokens")
    stride = F.greatest(F.lit(1), F.lit(budget - history) - F.col("system_tokens"))
    cell, last = F.floor(F.col("begin") / F.col("stride")), F.floor((F.col("begin") + F.col("tokens") - 1) / F.col("stride"))
    t = (
        t.withColumn("begin", F.when(F.col("is_system"), 0).otherwise(begin))
        .withColumn("stride", stride)
        .withColumn("window", 2 * cell + (cell != last).cast("int"))
    )
    recent = Window.partitionBy("conv_id").orderBy("begin").rangeBetween(-history, -1)
    t = t.withColumn("before", F.collect_list(F.struct("role", "text", "tokens", "begin")).over(recent))
    new = F.struct("position", "role", "text", "tokens")
    windows = t.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.when(~F.col("is_system"), new))).alias("new"),
        F.min_by("before", "position").alias("before"),
        F.first("system").alias("system"),
        F.min("position").alias("first"),
        F.min("begin").alias("begin"),
    )
    room = F.lit(budget) - F.coalesce(F.col("system.tokens"), F.lit(0)) - F.aggregate("new", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    windows = windows.withColumn("before", F.filter("before", lambda x: F.col("begin") - x["begin"] <= room))

    def part(x: Column, target: Column) -> Column:
        head = F.concat(F.lit(OPEN), escaped(x["role"]), F.lit(AFTER_ROLE))
        return F.struct(head.alias("head"), escaped(x["text"]).alias("body"), x["tokens"].alias("tokens"), target.alias("target"))

    old = F.concat(F.when(F.col("system").isNotNull(), F.array("system")).otherwise(F.array().cast("array<struct<role:string,text:string,tokens:bigint>>")), F.transform("before", lambda x: F.struct(x["role"], x["text"], x["tokens"])))
    parts = F.concat(
        F.transform(old, lambda x: part(x, F.lit(False))),
        F.transform("new", lambda x: part(x, x["role"] == TARGET)),
    )
    windows = windows.withColumn("parts", parts)
    whole = lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))

    def add(state: Column, x: Column) -> Column:
        here = F.struct((state["at"] + F.length(x["head"])).cast("long").alias("start"), F.length(x["body"]).cast("long").alias("length"))
        return F.struct(
            (state["at"] + F.length(whole(x))).cast("long").alias("at"),
            F.when(x["target"], F.concat(state["loss"], F.array(here))).otherwise(state["loss"]).alias("loss"),
        )

    return windows.select(
        "conv_id", "window",
        F.col("system").isNotNull().cast("int").alias("n_system"), F.size("before").alias("n_history"),
        F.when((F.col("first") == 2) & F.col("system").isNotNull(), 1).otherwise(F.col("first")).alias("first"),
        F.size("new").alias("n_new"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_tokens"),
        F.array_join(F.transform("parts", whole), "").alias("formatted"),
        F.aggregate("parts", start, add, lambda s: s["loss"]).alias("loss"),
    )


def turns_of(windows: DataFrame) -> Column:
    """Role and text of the turns that are new in a window, read from its text; the first window has the system turn too."""
    skip = F.col("n_history") + F.when(F.col("first") == 1, 0).otherwise(F.col("n_system"))
    found = F.split("formatted", "\n</turn>\n")
    whole = F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))
    new = F.slice(whole, skip + 1, F.size(whole))

    def turn(x: Column) -> Column:
        mark = F.instr(x, ">")
        role = F.substring(x, F.lit(len(OPEN) + 1), mark - len(OPEN) - 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(x, mark + len(AFTER_ROLE), F.length(x))).alias("text"))

    return F.transform(new, turn)


def loss_text_of(windows: DataFrame) -> Column:
    """All text of a window under its loss mask, as it was before it was escaped."""
    return F.array_join(F.transform("loss", lambda s: unescaped(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
