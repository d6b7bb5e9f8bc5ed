"""Chat formatting: messages folded from an event log, then rendered with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's marks: a message is TURN role BODY text END.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Control strings of this and other public templates: <|, <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>.
#: A text that has one, with any number of backslashes after its first sign, gets one more there.
CONTROL = r"(\||/?s>|/?INST\]|</?SYS>>)"
ESCAPE, UNESCAPE = rf"([<\[])(\\*){CONTROL}", rf"([<\[])\\(\\*){CONTROL}"
#: Kinds of events. All but delta begin the message's text anew.
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$2$3"))


def fold_events(events: DataFrame) -> DataFrame:
    """Messages (conv_id, message, role, text) from events (conv_id, seq, message, kind, role, text).

    Within a message, events apply by seq: ``message``, ``edit`` and ``regenerate`` replace what came before,
    ``delta`` appends. The role is the last one named. Null text is empty, a null kind is ``message``, null
    seq comes first. Events with equal seq apply by kind (delta last) and text, so reruns agree.
    """
    reset = F.coalesce(F.col("kind"), F.lit("message")) != "delta"
    order = [F.col("seq").asc_nulls_first(), reset.desc(), F.coalesce(F.col("kind"), F.lit("")), F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))]
    w = Window.partitionBy("conv_id", "message")
    ranked = events.withColumn("nth", F.row_number().over(w.orderBy(*order)))
    ranked = ranked.withColumn("base", F.coalesce(F.max(F.when(reset, F.col("nth"))).over(w), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.when(F.col("nth") >= F.col("base"), F.struct("nth", F.coalesce("text", F.lit("")).alias("part")))))
    return ranked.groupBy("conv_id", "message").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("nth"))).alias("role"),
        F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("text"),
    )


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Rendered conversations from an event log: conv_id, formatted, n_messages, loss_spans.

    loss_spans: for each message of loss_role, in order, its 0-based number, the 0-based code point in the
    whole output where its text starts, where that is within the message, and the (escaped) length. One
    shuffle, by conversation, serves folding, ordering and rendering; the rendered conversation is one value,
    so its size bounds a task. Messages come by their number, nulls first. A null role is empty. Further
    columns are not read. An empty log gives no rows.
    """
    log = events.select("conv_id", "seq", "message", "kind", "role", "text").repartition("conv_id")
    messages = (
        fold_events(log)
        .withColumn("head", F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(BODY)))
        .withColumn("body", escape(F.col("text")))
        .withColumn("segment", F.concat("head", "body", F.lit(END)))
    )
    by = Window.partitionBy("conv_id").orderBy(F.col("message").asc_nulls_first())
    placed = messages.select(
        "conv_id",
        (F.row_number().over(by) - 1).alias("nth"),
        "segment",
        F.coalesce(F.sum(F.length("segment").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.length("head").alias("head"),
        F.length("body").alias("length"),
        F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("lost"),
    )
    span = F.struct("nth", (F.col("offset") + F.col("head")).alias("start"), F.col("head").alias("within"), "length")
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "segment"))), lambda x: x["segment"]), "").alias("formatted"),
        F.count(F.lit(1)).alias("n_messages"),
        F.array_sort(F.collect_list(F.when(F.col("lost"), span))).alias("loss_spans"),
    )


def as_events(conversations: DataFrame) -> DataFrame:
    """The log of a table of finished turns (conv_id, turn, role, text): each row a message of its own.

    Rows that repeat a turn stay apart, ordered by role and text; null turns come first.
    """
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.coalesce("text", F.lit("")))
    return conversations.select("conv_id", F.row_number().over(by).alias("message"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """What format_chats put in: conv_id, turns array<struct<role, text>>, loss array<string>, formatted."""
    segments = F.split("formatted", r"<\|end\|>")
    parsed = formatted.withColumn("segments", F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))))

    def turn(segment: Column) -> Column:
        halves = F.split(segment, r"<\|body\|>", 2)
        return F.struct(unescape(F.substring(halves[0], len(TURN) + 1, 1 << 30)).alias("role"), unescape(halves[1]).alias("text"))

    return parsed.select(
        "conv_id",
        F.transform("segments", turn).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substring(F.get(F.col("segments"), s["nth"]), s["within"] + 1, s["length"]))).alias("loss"),
        "formatted",
    )
