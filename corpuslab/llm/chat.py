"""Chat formatting from event logs, with DataFrame functions only.

A log has events of messages: ``message`` begins one, ``delta`` adds streamed text to it, ``edit`` replaces its text,
``regenerate`` begins it anew. Editing or regenerating a message withdraws the later turns that were said before.
The events of each message are folded into its final text, and the messages of a conversation are rendered in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The template: <turn ROLE> line feed TEXT line feed </turn> line feed.
OPEN, CLOSE = "<turn ", "</turn>\n"
#: What is escaped in roles and texts, in this order; then each backslash is followed by b, l or g alone.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed(ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def rows_to_events(conversations: DataFrame, delta_chars: int = 400) -> DataFrame:
    """The event log of rows (conv_id, turn, role, text), as a chat service would have written it.

    A turn of the assistant begins as a draft, is regenerated and streams its text in deltas of ``delta_chars`` code
    points; any other turn is said with a slip and then edited. Rows of the same turn stay apart, in order of role and
    text; a null turn comes first. Folding the log gives each row's role and text.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("message"))
    event = lambda n, kind, role, text: F.struct(n.cast("long").alias("n"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    deltas = F.transform(
        F.sequence(F.lit(0), F.expr(f"cast((greatest(length(text), 1) - 1) div {int(delta_chars)} as int)")),
        lambda i: event(i + 2, "delta", none, F.substring(F.col("text"), i * int(delta_chars) + 1, F.lit(int(delta_chars)))),
    )
    streamed = F.concat(F.array(event(F.lit(0), "message", F.col("role"), F.lit("draft")), event(F.lit(1), "regenerate", none, F.lit(""))), deltas)
    edited = F.array(event(F.lit(0), "message", F.col("role"), F.lit("slip")), event(F.lit(1), "edit", none, F.col("text")))
    events = rows.select("conv_id", "message", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("e"))
    return events.select("conv_id", (F.col("message") * F.lit(1 << 32) + F.col("e.n")).alias("seq"), "message", "e.kind", "e.role", "e.text")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) of the final messages, from (conv_id, seq, message, kind, role, text).

    Events are taken by seq, ties by kind and text. A message's text is that of its last message, edit or regenerate
    event and of the deltas after it; its role is the last that is not null, else ''. Null texts are empty.
    """
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    anew = F.col("kind").isin("edit", "regenerate")
    folded = events.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(event)).alias("log"), F.max("seq").alias("last_seq"), F.max(F.when(anew, F.col("seq"))).alias("cut_seq")
    )
    starts = F.filter(F.transform("log", lambda e, i: F.when(e.kind != "delta", i + 1)), lambda i: i.isNotNull())
    first = F.coalesce(F.array_max(starts), F.lit(1))
    kept = F.slice("log", first, F.size("log"))
    roles = F.filter(F.transform("log", lambda e: e.role), lambda r: r.isNotNull())
    earlier = W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, -1)
    withdrawn = F.coalesce(F.max("cut_seq").over(earlier) > F.col("last_seq"), F.lit(False))
    return folded.withColumn("withdrawn", withdrawn).filter("NOT withdrawn").select(
        "conv_id", "message", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(kept, lambda e: e.text), "").alias("text"),
    )


def render(messages: DataFrame, train_on: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans) from (conv_id, message, role, text).

    loss_spans are (start, length) in code points of ``formatted``, from 0: the texts of the role that is trained on.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(">\n"))
    body = escape(F.col("text"))
    rows = messages.select("conv_id", "message", "role", head.alias("head"), body.alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit("\n" + CLOSE)))
    before = W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    rows = rows.select("conv_id", F.struct("message", "piece", start.alias("start"), F.length("body").cast("long").alias("length"), (F.col("role") == train_on).alias("train")).alias("m"))
    all_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    spans = F.transform(F.filter("ms", lambda m: m.train), lambda m: F.struct(m.start.alias("start"), m.length.alias("length")))
    return all_.select("conv_id", F.size("ms").cast("long").alias("n_turns"), F.array_join(F.transform("ms", lambda m: m.piece), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The (role, text) of each turn, read back from a rendered conversation."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, ">", 1)
        role = F.substring(head, F.lit(len(OPEN) + 1), F.length(head))
        text = F.substring(p, F.length(head) + 3, F.length(p) - F.length(head) - 3)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, in order, with nothing between."""
    cut = F.transform(spans, lambda s: F.substring(formatted, (s.start + 1).cast("int"), s.length.cast("int")))
    return F.array_join(F.transform(cut, unescape), "")


def chat_format(events: DataFrame) -> DataFrame:
    """Render an event log: (conv_id, n_turns, formatted, loss_spans), one row for each conversation with a message.

    Null conv_id is a conversation of its own; an empty log gives an empty result; other columns are not read.
    """
    return render(fold_events(events.select("conv_id", "seq", "message", "kind", "role", "text")))
