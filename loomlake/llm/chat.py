"""Chat formatting into windows of a token budget.

Turns are sorted by range over the cluster and numbered in that order; prefix sums of their tokens, within a partition and over
the few partition totals of a conversation, place every turn without bringing a conversation to one task. The sums are cut into cells as
wide as a window has room for own turns. Turns inside a cell are a window; a turn that crosses into the next cell joins its
cell's window if it fits, else the window of the cell that it ends in, else it is one by itself. So every window
keeps to the budget, but for a single turn that exceeds it, and no window waits for the one before it. Each later window begins
with the conversation's system turn and with the turns just before it, up to ``history`` tokens and the room that is left; those are context, and
their targets are not trained on again.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.frames import NULL_ID, WORD, shown, spread
from loomlake.scratch import Scratch

#: A turn is written as ``### role: text</turn>`` and a line break; texts and roles hold none of these strings unescaped.
OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: Column, role: bool = False) -> Column:
    """Backslashes are doubled; then control strings get backslashes inside, so that none is left whole."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>")), F.lit("###"), F.lit("\\#\\#\\#"))
    return F.replace(text, F.lit(":"), F.lit("\\:")) if role else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = 512, history: int = 128, target: str = "assistant") -> DataFrame:
    """Windows of conversations as text, with the spans to train on.

    Returns ``conv_col``, window (0, then rising, with gaps), n_turns (the window's own), n_context (turns repeated at its start), formatted,
    loss (spans of ``formatted``, in code points, that hold the escaped text of the window's own ``target`` turns).
    A turn has as many tokens as words and four for its marks. The system turn is a first turn of role system. A window's turns, context and system turn
    included, have ``budget`` tokens at most, unless it has one own turn that with the system turn exceeds them; that one gets no other context.
    ``history`` must not exceed ``budget``.

    Null texts and roles are empty. A null turn comes last, a null conversation is one conversation of its own. Turns with equal
    numbers go by role, then text; repeated rows are turns of their own. Extra columns are ignored; an empty table gives no windows.
    """
    if not 0 <= history <= budget:
        raise ValueError("history must not exceed budget")
    scratch = Scratch(turns.sparkSession, "chat")
    rows = turns.select(
        F.coalesce(turns[conv_col].cast("bigint"), F.lit(NULL_ID)).alias("k"), F.coalesce(turns[turn_col].cast("bigint"), F.lit(NULL_ID)).alias("turn"),
        F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"), F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text"),
    )
    order = ["k", "turn", "role", "text"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("g", F.monotonically_increasing_id())
    size = (F.regexp_count("text", F.lit(WORD)) + 4).cast("bigint")
    ordered = scratch.write(ranged.withColumn("part", F.shiftright("g", 33)).withColumn("tokens", size), "turns")
    first = ordered.groupBy("k").agg(F.min("g").alias("g"))
    system = scratch.write(ordered.join(first, ["k", "g"], "left_semi").where("role = 'system'").select("k", "g", "role", "text", "tokens"), "system")
    # the system turn is in every window, so it takes room from each and no place in the sums
    counted = ordered.join(system.select("g", F.lit(True).alias("s")), "g", "left").withColumn("system", F.col("s").isNotNull())
    counted = counted.withColumn("tokens", F.when(F.col("system"), 0).otherwise(F.col("tokens")))
    totals = counted.groupBy("k", "part").agg(F.sum("tokens").alias("sum")).join(system.select("k", F.col("tokens").alias("lead")), "k", "left")
    room = F.lit(budget) - F.coalesce("lead", F.lit(0))
    cell = F.greatest(room - history, F.floor(room / 2), F.lit(1)).cast("bigint")
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("k", "part", before.alias("offset"), room.alias("room"), cell.alias("cell"), F.col("lead").isNotNull().alias("led"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("k", "part").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("inside", inside).join(offsets, ["k", "part"]).withColumn("before", F.col("inside") + F.col("offset"))
    placed = placed.withColumn("at", F.expr("before div cell")).withColumn("to", F.expr("(before + tokens) div cell"))
    crossing = F.col("before") + F.col("tokens") > (F.col("at") + 1) * F.col("cell")
    placed = scratch.write(placed.select("k", "g", "role", "text", "system", "tokens", "before", "at", "to", crossing.alias("crossing"), "cell", "room", "led"), "placed")

    # of each cell: tokens of the turns inside, and the one turn, if any, that crosses out of it
    crosses = F.max(F.when(F.col("crossing"), F.col("tokens")))
    cells = placed.groupBy("k", "at").agg(F.coalesce(F.sum(F.when(~F.col("crossing"), F.col("tokens"))), F.lit(0)).alias("own"), crosses.alias("out"), F.first("cell").alias("cell"))
    cells = cells.withColumn("takes", F.coalesce((F.col("own") > 0) & (F.col("own") + F.col("out") <= F.col("cell")), F.lit(False)))
    cells = scratch.write(cells.withColumn("full", F.col("own") + F.when(F.col("takes"), F.col("out")).otherwise(0)), "cells")
    stays = cells.select("k", "at", "takes")
    ahead = cells.where("own > 0").select("k", F.col("at").alias("to"), "full")
    joined = placed.where("crossing").select("k", "g", "at", "to", "tokens", "cell").join(stays, ["k", "at"]).join(ahead, ["k", "to"], "left")
    with_next = F.coalesce(F.col("full") + F.col("tokens") <= F.col("cell"), F.lit(False))
    joined = joined.select("g", F.when(F.col("takes"), 2 * F.col("at") + 1).when(with_next, 2 * F.col("to") + 1).otherwise(2 * F.col("at") + 2).alias("w"))
    # the turns of cell 0 come first, and a turn that crosses out of it from its beginning, if no system turn is before it
    head = (F.col("w") == 1) | ((F.col("w") == 2) & (F.col("before") == 0) & ~F.col("led"))
    placed = scratch.write(placed.join(joined, "g", "left").withColumn("w", F.coalesce("w", 2 * F.col("at") + 1)).drop("at", "to", "crossing", "cell").withColumn("head", head), "windows")

    begins = placed.where("not head").groupBy("k", "w").agg(F.min("before").alias("begin"), F.sum("tokens").alias("own"), F.first("room").alias("room"))
    past_room = F.greatest(F.lit(0), F.least(F.lit(history), F.col("room") - F.col("own")))
    own = placed.select("k", "w", F.lit(False).alias("ctx"), "head", "g", "role", "text")
    span = max(1, history)
    reach = begins.withColumn("since", F.greatest(F.lit(0), F.col("begin") - past_room)).where("since < begin")
    reach = reach.select("k", "w", "begin", "since", F.explode(F.sequence(F.expr(f"since div {span}"), F.expr(f"(begin - 1) div {span}"))).alias("bucket"))
    turns_before = placed.where("not system").select("k", F.expr(f"before div {span}").alias("bucket"), "before", "g", "role", "text")
    past = turns_before.join(reach, ["k", "bucket"]).where("before >= since and before < begin").select("k", "w", F.lit(True).alias("ctx"), F.lit(False).alias("head"), "g", "role", "text")
    lead = spread(begins.select("k", "w"), system, "k", "w").select("k", "w", F.lit(True).alias("ctx"), F.lit(False).alias("head"), "g", "role", "text")
    windows = own.unionByName(past).unionByName(lead).groupBy("k", "w").agg(F.max("head").alias("head"), F.sort_array(F.collect_list(F.struct("g", "ctx", "role", "text"))).alias("turns"))
    pieces = F.transform("turns", lambda t: F.struct(t["ctx"].alias("ctx"), (t["role"] == target).alias("train"), F.concat(F.lit(OPEN), escape(t["role"], True), F.lit(MID)).alias("head"), escape(t["text"]).alias("body")))
    windows = windows.withColumn("pieces", pieces)

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        own_target = p["train"] & ~p["ctx"]
        return F.struct((end + len(CLOSE)).alias("at"), F.when(own_target, F.concat(acc["loss"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["loss"]).alias("loss"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("loss"))
    return windows.select(
        shown().alias(conv_col),
        F.when(F.col("head"), 0).otherwise(F.col("w") - 1).alias("window"),
        F.size(F.filter("pieces", lambda p: ~p["ctx"])).alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["ctx"])).alias("n_context"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("pieces", zero, step, lambda acc: acc["loss"]).alias("loss"),
    )


def _read(batches):
    """Streams windows in (conversation, window) order; holds one window and two running digests at a time."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["k", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    last, state, rows = None, None, []

    def done():
        rows.append((last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for batch in batches:
        for k, context, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("k", "n_context", "formatted", "loss")), strict=True):
            if k != last or state is None:
                if state is not None:
                    done()
                last, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted)[context:]:
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = unescape(formatted[span["start"] : span["end"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
        if len(rows) > 2000:
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows = []
    if state is not None:
        done()
    if rows:
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What formatted windows hold, by conversation: turns and their digest, text under the loss mask and its digest, characters.

    A digest over a conversation is sequential, so its windows meet in one task, which streams them in order.
    """
    keyed = windows.select(F.coalesce(windows[conv_col], F.lit(NULL_ID)).alias("k"), "window", "n_context", "formatted", "loss")
    out = keyed.repartition("k").sortWithinPartitions("k", "window").mapInArrow(_read, "k long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.select(shown().alias(conv_col), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
