"""Chat formatting from an event log, with DataFrame functions only.

Events (conv_id, seq, kind, message, role, text) describe messages, numbered within a conversation:
`delta` appends its text to the message; `edit` replaces what the message held; `regenerate` does too, and
drops every later message's events so far, for those answered the old text. Later deltas append to an
edited or regenerated message. Events are dealt by conversation and sorted by seq; two window maxima say which
events still count, and one grouped list folds them into messages.

Template: `<s>` role `<|im_sep|>` text `</s>` for each message, in order. Control strings inside roles and
texts are broken up reversibly: `~` is doubled, and a `~` follows the first character of every control string.

Defined results: null text or role is empty; a null message number sorts first; a null conv_id is a
conversation of its own; of events with equal seq and message, the order is that of kind, role, text;
an empty table gives no rows; other columns are ignored. One conversation makes one value, so its
messages, however long their texts, must fit into a task, several times over. Spans come from a running sum over the messages,
so that the time is in proportion to their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, SEP, CLOSE = "<s>", "<|im_sep|>", "</s>"
#: Where a control string begins: its first character, and what follows.
_CONTROL = r"([<\[])(?=/?s>|\|im_(?:sep|start|end)\|>|</?SYS>>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("~"), F.lit("~~")), _CONTROL, "$1~")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "~(~?)", "$1")


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, messages array<struct<message, role, text>>) after all deltas, edits and regenerations."""
    by = Window.partitionBy("conv_id")
    resets = F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))
    same = Window.partitionBy("conv_id", "message")
    earlier = by.orderBy(F.col("message").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, -1)
    dropped = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier)
    live = (
        events.select(F.col("conv_id").cast("long"), F.col("seq").cast("long"), "kind", F.col("message").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
        .withColumns({"_dropped": dropped, "_reset": F.max(resets).over(same)})
        .where("(_dropped is null or seq > _dropped) and (_reset is null or seq >= _reset)")
    )
    part = F.struct(F.col("message"), "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = live.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(part)).alias("_parts"))
    text = F.array_join(F.col("_parts.text"), "")
    whole = parts.select("conv_id", F.struct("message", F.col("_parts")[0]["role"].alias("role"), text.alias("text")).alias("_whole"))
    return whole.groupBy("conv_id").agg(F.sort_array(F.collect_list("_whole")).alias("messages"))


def render(folded: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss array<struct<start, end>>): code points of the assistant texts, end exclusive.

    The messages are exploded, and a running sum of their lengths, over the partitions by conversation that the fold has left, says where each ends.
    """
    rows = folded.select("conv_id", F.posexplode("messages").alias("pos", "_m")).select("conv_id", "pos", F.col("_m.role").alias("role"), escape(F.col("_m.role")).alias("head"), escape(F.col("_m.text")).alias("body"))
    piece = F.concat(F.lit(OPEN), F.col("head"), F.lit(SEP), F.col("body"), F.lit(CLOSE))
    so_far = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("piece", piece).withColumn("end", (F.sum(F.length("piece")).over(so_far) - len(CLOSE)).cast("int"))
    own = F.struct("pos", "piece", "role", (F.col("end") - F.length("body")).alias("start"), "end")
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(own)).alias("_p"))
    spans = F.transform(F.filter("_p", lambda p: p["role"] == "assistant"), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    return whole.select("conv_id", F.array_join("_p.piece", "").alias("formatted"), spans.alias("loss"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    turns = F.filter(F.split(formatted, F.lit(CLOSE), -1), lambda x: x != "")
    cut = F.transform(turns, lambda x: F.split(F.substr(x, F.lit(len(OPEN) + 1)), r"<\|im_sep\|>", -1))
    return F.transform(cut, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


#: Spans of a conversation from which its text is cut into characters once, instead of being searched from its beginning for each span.
MANY_SPANS = 256


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    one = F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
    letters = F.regexp_extract_all(formatted, F.lit("(?s)."), F.lit(0))
    cut = F.aggregate(F.array(letters), F.lit(""), lambda _, a: F.array_join(F.transform(loss, lambda s: unescape(F.array_join(F.slice(a, s["start"] + 1, s["end"] - s["start"]), ""))), ""))  # one element: the letters are made once
    return F.when(F.size(loss) < MANY_SPANS, one).otherwise(cut)


def format_chats(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of an event log."""
    return render(messages(events))


def log_of(rows: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as an event log: one delta a row, in the order of turn, role, text."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    return rows.select("conv_id", nth.alias("seq"), F.lit("delta").alias("kind"), nth.alias("message"), "role", "text")


def storied_log(rows: DataFrame) -> DataFrame:
    """The same turns with a history: of each message a draft is streamed and answered, then it is regenerated, which drops the answer, edited, and streamed on in two deltas. The fold gives the turns."""
    log = log_of(rows).withColumn("text", F.coalesce("text", F.lit("")))
    n, third = F.col("message"), F.floor(F.length("text") / 3).cast("int")
    piece = lambda start, length: F.substring(F.col("text"), start, length)
    event = lambda at, kind, message, text: F.struct((F.col("seq") * 8 + at).alias("seq"), F.lit(kind).alias("kind"), message.alias("message"), text.alias("text"))
    story = F.array(
        event(0, "delta", n, F.concat(F.lit("draft of "), F.col("text"))), event(1, "delta", n + 1, F.lit("an answer to the draft")), event(2, "regenerate", n, F.lit("another draft")),
        event(3, "edit", n, piece(F.lit(1), third)), event(4, "delta", n, piece(third + 1, third)), event(5, "delta", n, piece(2 * third + 1, F.length("text"))),
    )
    return log.select("conv_id", "role", F.explode(story).alias("_e")).select("conv_id", "_e.seq", "_e.kind", "_e.message", "role", "_e.text")
