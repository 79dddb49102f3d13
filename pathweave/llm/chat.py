"""Chat formatting from an event log.

Conversations arrive as events: whole messages, streamed deltas, edits and
regenerations. The log is partitioned by conversation, put in order of its
sequence numbers and folded into final messages, which are then rendered with
a reversible template and the spans that a training loss covers.

All of it is DataFrame functions; a conversation is the unit of work, as its
rendered text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.llm.common import let

# Fixed values of the template. Texts and roles never hold "<" once escaped,
# so the marks below can't occur in them.
OPEN, BODY, CLOSE = "<turn ", ">\n", "</turn>\n"
LEARNED_ROLE = "assistant"
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    """Escape the template's control characters: a backslash to \\b, then < to \\l."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Undo ``escape``: every backslash in an escaped text is followed by b or l."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of an event log.

    Columns of ``events``: conv_id, seq, kind, turn, role, text. In order of seq
    (ties: by kind, role and text):

    * message: the turn's text is this text, from now on in this role;
    * edit: the turn's text is this text, the role stays;
    * delta: this text is added to the turn's text;
    * regenerate: what this turn and all later turns of the conversation said
      before is dropped; later events write them again.

    Null texts are empty; a turn's role is that of its last surviving event with
    a role, else empty. Unknown kinds count as message. Null conv_ids are one
    conversation. Events without a turn or seq are dropped from the log only if
    both are null; a null turn is the turn before all others. A turn left without
    events is no message. Further columns are dropped.
    """
    e = events.filter(~(F.col("turn").isNull() & F.col("seq").isNull())).select(
        F.col("conv_id").alias("conv_id"), F.coalesce(F.col("seq").cast("bigint"), F.lit(0)).alias("seq"),
        F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("message").alias("kind"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)).alias("turn"),
        F.col("role").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # dropped by a later regeneration of this turn or of one before it: the running
    # maximum of regenerations over turns, so one sorted pass for each conversation
    upto = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("cut", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(upto))
    e = e.filter((F.col("kind") != "regenerate") & (F.col("cut").isNull() | (F.col("seq") > F.col("cut"))))
    log = F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text")))
    whole = F.array_max(F.transform("log", lambda x, i: F.when(x["kind"] == "delta", F.lit(1)).otherwise(i + 1)))
    parts = F.transform(F.slice("log", whole, F.size("log")), lambda x: x["text"])
    role = F.try_element_at(F.filter("log", lambda x: x["role"].isNotNull()), F.lit(-1))["role"]
    g = e.groupBy("conv_id", "turn").agg(log.alias("log"))
    return g.select("conv_id", "turn", F.coalesce(role, F.lit("")).alias("role"), F.array_join(parts, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    Messages go in order of turn. loss_spans are [start, end) code points of
    ``formatted`` that hold the texts of the assistant.
    """
    m = messages.select("conv_id", "turn", (F.col("role") == LEARNED_ROLE).alias("learned"),
                        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BODY)).alias("head"),
                        escape(F.col("text")).alias("body"))
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("head") + F.length("body") + len(CLOSE)).over(so_far) - len(CLOSE)
    m = m.withColumn("span", F.struct((end - F.length("body")).alias("start"), end.alias("end")))
    one = F.struct("turn", "head", "body", "learned", "span")
    g = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return g.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["span"]).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text), read back from the text alone."""
    parts = F.split(formatted, CLOSE)  # CLOSE holds no character that is special in a pattern
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p: Column) -> Column:
        head = F.length(F.substring_index(p, BODY, 1))
        return F.struct(unescape(F.substring(p, F.lit(len(OPEN) + 1), head - len(OPEN))).alias("role"),
                        unescape(F.substring(p, head + len(BODY) + 1, F.length(p))).alias("text"))

    return F.transform(parts, turn)


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of rendered conversations, from ``formatted`` and ``loss_spans`` alone."""
    turns = parse(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return rendered.select(
        "conv_id", F.size(turns).cast("bigint").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        let(learned, lambda x: F.struct(F.length(x).cast("bigint").alias("loss_chars"),
                                        F.sha2(F.encode(x, "UTF-8"), 256).alias("loss_sha256"))).alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    ).select("conv_id", "n_turns", "turns_sha256", "loss.loss_chars", "loss.loss_sha256", "formatted_chars")


def as_events(rows: DataFrame) -> DataFrame:
    """Stored conversation rows (conv_id, turn, role, text) as an event log: one message event for each row.

    Rows of one conversation go by turn; equal turns by role and text. Each row
    is a message of its own, so repeated rows stay.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn"), F.col("role"), F.col("text"))
    n = F.row_number().over(order).cast("bigint")
    return rows.select("conv_id", "turn", "role", "text").withColumn("seq", n).select(
        "conv_id", "seq", F.lit("message").alias("kind"), F.col("seq").alias("turn"), "role", "text")


def streamed(log: DataFrame) -> DataFrame:
    """A log of whole messages as a live system would have written it; it folds to the same messages.

    By a hash of conversation and turn a message is kept whole, streamed as a beginning and deltas, sent with another text and
    edited, or drafted, discarded by a regeneration and streamed anew. Sequence numbers keep the order of the messages.
    """
    n = F.length("text")
    third, half = F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")
    none = F.lit(None).cast("string")

    def event(step: int, kind: str, role: Column, text: Column) -> Column:
        return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    role, text = F.col("role"), F.col("text")
    whole = [event(0, "message", role, text)]
    deltas = [event(0, "message", role, F.substring(text, F.lit(1), third)), event(1, "delta", none, F.substring(text, third + 1, third)),
              event(2, "delta", none, F.substring(text, third * 2 + 1, n))]
    edited = [event(0, "message", role, F.concat(F.lit("draft: "), text)), event(1, "delta", none, F.lit("...")), event(2, "edit", none, text)]
    again = [event(0, "message", F.lit("draft"), F.lit("let me")), event(1, "delta", none, F.lit(" think")), event(2, "regenerate", none, none),
             event(3, "message", role, F.substring(text, F.lit(1), half)), event(4, "delta", none, F.substring(text, half + 1, n))]
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    events = F.when(way == 0, F.array(*deltas)).when(way == 1, F.array(*edited)).when(way == 2, F.array(*again)).otherwise(F.array(*whole))
    e = log.withColumn("e", F.explode(events))
    return e.select("conv_id", (F.col("seq") * 8 + F.col("e.step")).alias("seq"), F.col("e.kind").alias("kind"), "turn",
                    F.col("e.role").alias("role"), F.col("e.text").alias("text"))
