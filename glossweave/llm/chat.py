"""Chat formatting from event logs, in DataFrame expressions only.

A log row is an event of a message: ``start`` opens it with a role, ``delta`` appends text, ``edit``
replaces the text so far, ``regenerate`` throws it away.  Logs are partitioned by conversation and message,
sorted by sequence and folded in two levels (spans of events, then messages), and the messages of a
conversation are rendered in spans too before they are joined, so that no task gathers a hot
conversation's events one by one.

Rendered turns are ``<|im_start|>role``, a line end, the text, ``<|im_end|>``, a line end.  Inside texts and roles
every ``<``, backslashes, ``|`` gets one more backslash, so the marks cannot occur there; roles also write
``~`` as ``~0`` and line ends as ``~1``.  Both are undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Sequence numbers in a span that is gathered at once.
SPAN = 256
RESETS = ("edit", "regenerate")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))


def conversation_events(turns: DataFrame, piece: int = 400) -> DataFrame:
    """An event log that leads to a table of finished turns (conv_id, turn, role, text).

    A message is streamed as such logs are: a start, a first delta that an edit replaces by the text's first third, a delta up
    to its middle, a regeneration of all that, the whole text in deltas of ``piece`` code points.  Rows that share a
    turn are messages of their own, in the order of role and whole text; repeated rows are repeated turns.
    """
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    tie = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = rows.withColumn("msg", F.concat_ws(".", "turn", F.format_string("%010d", tie)))
    length = F.char_length("text")
    none = F.lit(None).cast("string")

    def event(kind: str, text: Column, role: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    third, half = F.floor(length / 3).cast("int"), F.floor(length / 2).cast("int")
    drafts = F.array(
        event("delta", F.lit("...")), event("edit", F.substring("text", F.lit(1), third)), event("delta", F.substring("text", third + 1, half - third)), event("regenerate", none)
    )
    deltas = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(length, F.lit(1)) - 1) / piece).cast("int")), lambda k: event("delta", F.substring("text", k * piece + 1, F.lit(piece))))
    log = F.concat(F.array(event("start", F.lit(""), F.col("role"))), drafts, deltas)
    return rows.select("conv_id", "msg", "turn", F.posexplode(log).alias("step", "e")).select("conv_id", "msg", F.col("turn").alias("seq"), F.col("step").cast("long").alias("step"), "e.*")


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, seq (of the first event), msg, role (of the first event that has one), text of every message.

    Events are in the order of seq and, where the log has that column, of step.  Events of one place are taken by kind
    (delta, edit, regenerate, start), then text; a null sequence comes first, a null text is empty, an unknown kind changes nothing.
    """
    if "step" in events.columns:
        step, span = F.col("step"), F.struct("seq", F.floor(F.coalesce("step", F.lit(-1)) / SPAN).alias("part"))
    else:
        step, span = F.lit(0).cast("long"), F.struct(F.lit(None).cast("long").alias("seq"), F.floor(F.coalesce("seq", F.lit(-1)) / SPAN).alias("part"))
    kinds = events.select("conv_id", "msg", "seq", step.alias("step"), F.col("kind"), "role", F.coalesce("text", F.lit("")).alias("text"), span.alias("span"))
    reset = F.col("kind").isin(*RESETS)
    entry = F.struct("seq", "step", "kind", "text", reset.alias("reset"))
    known = F.col("kind").isin("start", "delta", *RESETS)
    spans = kinds.groupBy("conv_id", "msg", "span").agg(
        F.sort_array(F.collect_list(F.when(known, entry))).alias("log"),
        F.min("seq").alias("seq"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "step", "role"))).alias("role"),
    )

    def last_reset(log: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(log, lambda e, i: F.when(e["reset"], i).otherwise(-1))), F.lit(-1))

    def text_from(log: Column, at: Column) -> Column:
        return F.array_join(F.transform(F.filter(log, lambda e, i: (i >= at) & (e["kind"] != "regenerate")), lambda e: e["text"]), "")

    at = last_reset(F.col("log"))
    spans = spans.withColumn("at", at).select("conv_id", "msg", "seq", "role", F.struct("span", F.lit("delta").alias("kind"), text_from(F.col("log"), F.col("at")).alias("text"), (F.col("at") >= 0).alias("reset")).alias("part"))
    whole = spans.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list("part")).alias("log"), F.min("seq").alias("seq"), F.min("role")["role"].alias("role"))
    return whole.withColumn("at", last_reset(F.col("log"))).select("conv_id", "seq", "msg", F.coalesce("role", F.lit("")).alias("role"), text_from(F.col("log"), F.col("at")).alias("text"))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_mask: for each turn the start and length, in code points from the turn's own start mark, that count for the loss.

    Messages are in the order of seq and msg; the mask of a turn of another role has length 0.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = messages.select("conv_id", "seq", "msg", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == trained).alias("on"))
    turns = turns.select(
        "conv_id",
        F.floor(F.coalesce("seq", F.lit(-1)) / SPAN).alias("span"),
        F.struct("seq", "msg", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), F.struct(F.char_length("head").alias("start"), F.when(F.col("on"), F.char_length("body")).otherwise(0).alias("length")).alias("mask")).alias("turn"),
    )
    spans = turns.groupBy("conv_id", "span").agg(F.sort_array(F.collect_list("turn")).alias("t")).select("conv_id", F.struct("span", F.array_join("t.piece", "").alias("text"), F.col("t.mask").alias("mask")).alias("s"))
    whole = spans.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return whole.select("conv_id", F.array_join("s.text", "").alias("formatted"), F.flatten("s.mask").alias("loss_mask"))


def parse(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss (the unescaped text under the mask of each trained turn), read back from rendered text."""
    pieces = F.slice(F.split("formatted", START.replace("|", r"\|")), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        line = F.instr(piece, "\n")
        body = F.substring(piece, line + 1, F.char_length(piece) - line - (len(END) + 1))
        return F.struct(unescape_role(F.substring(piece, F.lit(1), line - 1)).alias("role"), unescape(body).alias("text"))

    def masked(piece: Column, mask: Column) -> Column:
        return unescape(F.substring(piece, mask["start"] - len(START) + 1, mask["length"]))

    return rendered.withColumn("pieces", pieces).select(
        "conv_id", F.transform("pieces", turn).alias("turns"), F.filter(F.zip_with("pieces", "loss_mask", lambda p, m: F.when(m["length"] > 0, masked(p, m))), lambda x: x.isNotNull()).alias("loss"), "formatted"
    )


def digests(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of rendered conversations."""
    return (
        parse(rendered)
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("t"), F.array_join("loss", "").alias("l"), "formatted")
        .select("conv_id", "n_turns", F.sha2("t", 256).alias("turns_sha256"), F.char_length("l").cast("long").alias("loss_chars"), F.sha2("l", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    )


def format_conversations(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """Rendered conversations of a table of turns; see render().  An empty table gives no rows; null texts and roles are empty."""
    return render(fold_events(conversation_events(turns)), trained)
