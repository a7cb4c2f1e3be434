"""Conversations as training windows under a token budget, in DataFrame functions only.

Prefix sums of turn tokens place every turn on a grid of half the room that the system
turn leaves; the turns that end in one cell are the targets of one window. The window
repeats the system turn and, as far as budget and ``history`` allow, the turns before it.
Repeated turns are marked and carry no loss.

Format: each turn is ``<turn =role>text</turn>``, or ``<turn ~role>text</turn>`` where it is
repeated. Inside roles and texts ``\\`` is written ``\\b`` and ``<`` is written ``\\l`` (in
roles also ``>`` as ``\\g``), so no control string occurs there and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from tickframe.llm.neardup import written

#: Tokens of a window, and most tokens of repeated history.
BUDGET, HISTORY = 512, 128
#: A turn's tokens are its words and this many for its markers.
MARKERS = 2
CLOSE = "</turn>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Every backslash of an escaped text begins an escape, so the order of the steps is safe."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def _placed(turns: DataFrame, conv: str, turn: str, role: str, text: str, budget: int) -> DataFrame:
    """Turns in order with their prefix sums, the room their conversation has, and their window."""
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    order = Over.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumns(
        {
            "idx": F.row_number().over(order),
            "followed": F.lead(F.lit(True)).over(order).isNotNull(),
            "cost": F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + MARKERS,
        }
    ).withColumn("system", (F.col("idx") == 1) & (F.col("role") == "system") & F.col("followed"))
    so_far = order.rowsBetween(Over.unboundedPreceding, Over.currentRow)
    rows = rows.withColumns(
        {
            "room": F.greatest(
                F.lit(budget) - F.max(F.when(F.col("system"), F.col("cost")).otherwise(0)).over(so_far),
                F.lit(max(2, budget // 4)),
            ),
            "end": F.sum(F.when(F.col("system"), 0).otherwise(F.col("cost"))).over(so_far),
        }
    )
    half = F.expr("room div 2")
    # a turn longer than a cell is alone in its window; what else ends in its cell comes after it
    return rows.withColumns(
        {
            "start": F.col("end") - F.col("cost"),
            "window": F.floor((F.col("end") - 1) / half) * 2 + F.when(F.col("cost") > half, 0).otherwise(1),
        }
    ).drop("followed", "turn")


def budgeted_windows(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
) -> DataFrame:
    """One row per window: ``conv_col``, window, text, loss, n_tokens, over_budget.

    ``loss`` lists the spans ``(start, stop)`` of assistant texts, in code points of ``text``;
    every assistant turn is a target of exactly one window. Windows ascend within a
    conversation without being consecutive. ``over_budget`` marks windows that one long turn
    (or system turn) takes beyond the budget; nothing is cut off.

    Rows without text or role have empty ones. Equal turn numbers are ordered by role and
    text, null ones come first, repeated rows are turns of their own, null conversation ids
    are one conversation. A first turn by ``system`` is the system turn unless it is alone.
    Other columns are not read. A conversation's prefix sums run in one task (sorted, not
    held in memory); windows are put together by conversation and window.
    """
    rows = written(_placed(turns, conv_col, turn_col, role_col, text_col, budget), "turns")
    plain = rows.where(~F.col("system"))
    spans = plain.groupBy("conv", "window").agg(
        F.min("start").alias("at"), F.sum("cost").alias("targets"), F.first("room").alias("room")
    )
    grid = max(history, 1)
    spans = spans.select(
        F.col("conv").alias("w_conv"),
        F.col("window").alias("w"),
        "at",
        F.greatest(F.least(F.lit(history), F.col("room") - F.col("targets")), F.lit(0)).alias("spare"),
        F.floor(F.col("at") / grid).alias("w_cell"),
    )

    def part(again: Column, window: str) -> list[Column]:
        return [
            F.col("conv"),
            F.col(window).alias("window"),
            F.struct(
                "idx",
                F.concat(
                    F.lit("<turn "), F.when(again, "~").otherwise("="), _escape_role(F.col("role")), F.lit(">")
                ).alias("head"),
                escape(F.col("text")).alias("body"),
                (~again & (F.col("role") == "assistant")).alias("loss"),
                "cost",
            ).alias("part"),
        ]

    # a window begins at most `history` tokens after a turn that it repeats: in its cell or the next
    near = plain.withColumn("cell", F.explode(F.array(F.floor(F.col("end") / grid), F.floor(F.col("end") / grid) + 1)))
    before = near.join(
        spans,
        F.col("conv").eqNullSafe(F.col("w_conv"))
        & (F.col("cell") == F.col("w_cell"))
        & (F.col("end") <= F.col("at"))
        & (F.col("start") >= F.col("at") - F.col("spare")),
    )
    first = rows.where("system").join(spans, F.col("conv").eqNullSafe(F.col("w_conv")))
    parts = (
        plain.select(*part(F.lit(False), "window"))
        .union(before.select(*part(F.lit(True), "w")))
        .union(first.select(*part(F.col("at") > 0, "w")))
    )
    gathered = parts.groupBy("conv", "window").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)
    step = lambda acc, p: F.struct(
        (acc["at"] + size(p)).alias("at"),
        F.when(
            p["loss"],
            F.array_append(
                acc["spans"],
                F.struct(
                    (acc["at"] + F.length(p["head"])).alias("start"),
                    (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("stop"),
                ),
            ),
        )
        .otherwise(acc["spans"])
        .alias("spans"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<struct<start:int,stop:int>>").alias("spans"))
    tokens = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["cost"])
    return gathered.select(
        F.col("conv").alias(conv_col),
        "window",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("text"),
        F.aggregate("parts", zero, step)["spans"].alias("loss"),
        tokens.alias("n_tokens"),
        (tokens > budget).alias("over_budget"),
    )


def read_turns(text: str = "text") -> Column:
    """The turns a window adds, read from its text: an array of (role, text) without repeated turns."""
    pieces = F.filter(F.split(F.col(text), CLOSE), lambda p: F.startswith(p, F.lit("<turn =")))
    return F.transform(
        pieces,
        lambda p: F.struct(
            _unescape_role(F.substr(F.substring_index(p, ">", 1), F.lit(8))).alias("role"),
            unescape(F.substr(p, F.instr(p, ">") + 1)).alias("text"),
        ),
    )


def read_loss(text: str = "text", loss: str = "loss") -> Column:
    """All text under the loss mask of a window, unescaped."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substr(F.col(text), s["start"] + 1, s["stop"] - s["start"]))), ""
    )


def conversation_digests(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation what its windows hold, read back from their texts and masks."""
    back = windows.select(
        F.col(conv_col),
        F.struct(
            "window",
            read_turns().alias("turns"),
            read_loss().alias("loss"),
            F.length("text").cast("long").alias("chars"),
        ).alias("w"),
    )
    whole = back.groupBy(conv_col).agg(F.sort_array(F.collect_list("w")).alias("w"))
    turns = F.flatten(F.transform("w", lambda w: w["turns"]))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("w", lambda w: w["loss"]), "")
    return whole.select(
        conv_col,
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("w", F.lit(0).cast("long"), lambda n, w: n + w["chars"]).alias("formatted_chars"),
    )
