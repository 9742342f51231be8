"""Chat logs: events folded to final messages, rendered with marks, and read back.

A log row is ``(conv_id, seq, event, message, role, text)``. Events of a message:
``open`` starts it and gives its role, ``delta`` adds text, ``edit`` replaces all text so
far, ``regenerate`` throws it away so that new deltas follow, ``delete`` removes the
message until it is opened again. Messages are shown in the order of ``message``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Control strings that texts may not show as they are. Each begins with the only < or [
# that it holds, so no two of them overlap in a text.
_REST = r"(\|turn\|>|\|end\|>|s>|/s>|INST\]|/INST\])"
ESCAPE = r"([<\[])(\\*)" + _REST
UNESCAPE = r"([<\[])(\\*)\\" + _REST
TURN, END = "<|turn|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    """A backslash more after the first character of each control string."""
    return F.regexp_replace(text, ESCAPE, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    """The way back: control strings that carry backslashes lose one."""
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def log_of(turns: DataFrame, delta_chars: int = 512) -> DataFrame:
    """The event log of whole turns ``(conv_id, turn, role, text)``.

    Each row opens a message and streams its text in deltas. Null roles and texts are
    empty. Rows of one conversation with equal turns are messages of their own, ordered by
    role and text; null turns come first.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.select("conv_id", F.row_number().over(w).cast("bigint").alias("message"), "role", "text")
    steps = F.ceil(F.length("text") / delta_chars).cast("int")
    events = F.concat(
        F.array(F.struct(F.lit(0).alias("step"), F.lit("open").alias("event"), F.lit("").alias("part"))),
        F.transform(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
                    lambda i: F.struct(i.alias("step"), F.lit("delta").alias("event"),
                                       F.substr("text", (i - 1) * delta_chars + 1, F.lit(delta_chars))
                                       .alias("part"))))
    return (rows.withColumn("e", F.explode(events))
            .select("conv_id", (F.col("message") * (1 << 32) + F.col("e.step")).alias("seq"),
                    F.col("e.event").alias("event"), "message", "role",
                    F.col("e.part").alias("text")))


def fold(log: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, message, role, text)`` of an event log.

    A conversation is sorted by sequence; what came before the last event that starts a
    text anew is dropped, the rest is joined in order. Equal sequence numbers are taken in
    the order of event and text. Repeated identical rows count once, as a log delivered
    twice should. A message that is not open at the end is left out; a message that was
    never opened has the role of its first event, or an empty one. Nulls are empty.
    """
    rows = log.select("conv_id", "seq", "event", "message", F.coalesce("role", F.lit("")).alias("role"),
                      F.coalesce("text", F.lit("")).alias("text")).distinct()
    order = Window.partitionBy("conv_id", "message").orderBy("seq", "event", "text")
    rows = rows.withColumn("at", F.row_number().over(order))
    whole = Window.partitionBy("conv_id", "message")
    anew = F.col("event").isin("open", "edit", "regenerate", "delete")
    rows = (rows.withColumn("last", F.max(F.when(anew, F.col("at"))).over(whole))
            .withColumn("gone", F.max_by(F.when(anew, F.col("event")), F.when(anew, F.col("at"))).over(whole))
            .withColumn("role", F.coalesce(
                F.max_by("role", F.when(F.col("event") == "open", F.col("at"))).over(whole),
                F.min_by("role", "at").over(whole)))
            .where("coalesce(gone, '') <> 'delete' and at >= coalesce(last, 0)"))
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    return (rows.groupBy("conv_id", "message", "role").agg(parts.alias("parts"))
            .select("conv_id", "message", "role",
                    F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")))


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``(conv_id, formatted, loss)``: one text per conversation and its loss mask.

    ``loss`` lists the spans (code points, end exclusive) of the texts of ``learn`` roles,
    as they stand in ``formatted``. A conversation is one row of output, so it has to fit
    into memory; rows with a null ``conv_id`` form one conversation.
    """
    head = F.concat(F.lit(TURN), F.url_encode("role"), F.lit("\n"))
    rows = messages.select("conv_id", "message", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumn("shown", F.concat("head", "body", F.lit(END)))
    w = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("shown").cast("bigint")).over(w), F.lit(0)) + F.length("head")
    learned = F.col("role").isin(*learn)
    spans = F.array_sort(F.collect_list(F.when(learned, F.struct(
        F.col("begin").alias("start"), (F.col("begin") + F.length("body")).alias("end")))))
    shown = F.array_sort(F.collect_list(F.struct("message", "shown")))
    return (rows.withColumn("begin", begin)
            .groupBy("conv_id").agg(shown.alias("shown"), spans.alias("loss"))
            .select("conv_id", F.array_join(F.transform("shown", lambda s: s["shown"]), "").alias("formatted"), "loss"))


def parse(formatted: DataFrame) -> DataFrame:
    """Turns and learned text out of rendered conversations.

    ``turns`` lists ``(role, text)`` in order; ``learned`` is the text under the loss mask,
    span by span, unescaped.
    """
    pieces = F.split("formatted", r"<\|end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        line = F.substring_index(p, "\n", 1)
        role = F.url_decode(F.substr(line, F.lit(len(TURN) + 1)))
        return F.struct(role.alias("role"), unescaped(F.substr(p, F.length(line) + 2)).alias("text"))

    learned = F.transform("loss", lambda s: unescaped(
        F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"),
                            learned.alias("learned"))
