"""Chat formatting by event sourcing.

A log holds events of conversations in any order: a message is opened, gets text in
streamed deltas, may be edited (its text replaced) or regenerated (its text and all
later messages opened so far discarded).  The log is partitioned by conversation and
message, sorted by sequence and folded into final messages; these are rendered with
a template whose marks are escaped inside texts, so that the output can be read back.

The events are grouped by message before they are grouped by conversation, so a long
conversation is folded by many tasks; only its final text comes together, as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Marks of the template: <s>[INST]role[/INST]text</s> for every turn.
TURN, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
EVENT_KINDS = ("open", "delta", "edit", "regenerate")
DELTA_CHARS = 256


def escape(text: Column) -> Column:
    """Put one more backslash behind the first character of every mark in a text."""
    return F.regexp_replace(text, r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])", r"$1$4\\$2$5$3$6")


def unescape(text: Column) -> Column:
    """Take one backslash out of every escaped mark: the inverse of `escape`."""
    return F.regexp_replace(text, r"(<)\\(\\*)(/?s>)|(\[)\\(\\*)(/?INST\])", "$1$4$2$5$3$6")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log (conv_id, message, seq, kind, role, text).

    Events of equal seq are taken in the order of EVENT_KINDS, then by text; an event that
    occurs twice counts once.  A null text adds nothing, a null role is empty.  A
    message never opened has the role of its first event.
    """
    rank = F.array_position(F.array(*map(F.lit, EVENT_KINDS)), F.col("kind"))
    event = F.struct("seq", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    reset = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq")))
    regenerated = F.max(F.when(F.col("kind") == "regenerate", F.col("seq")))
    opened = F.coalesce(F.min(F.when(F.col("kind") == "open", F.col("seq"))), F.min("seq"))
    messages = events.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_set(event)).alias("log"), reset.alias("reset"), regenerated.alias("regenerated"), opened.alias("opened")
    )
    live = F.filter("log", lambda e: F.col("reset").isNull() | (e.seq >= F.col("reset")))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    return (
        messages.withColumn("discarded", F.max("regenerated").over(before))
        .filter(F.col("discarded").isNull() | (F.col("opened") > F.col("discarded")))
        .select("conv_id", "message", F.get(F.col("log"), F.lit(0))["role"].alias("role"), F.array_join(F.transform(live, lambda e: e.text), "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: `formatted` and `loss_spans`, the (start, length) of the assistant texts in it."""
    text, role = escape(F.coalesce("text", F.lit(""))), F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(TURN + HEAD), escape(role), F.lit(BODY))
    turn = F.struct(
        "message",
        F.concat(head, text, F.lit(END)).alias("piece"),
        F.length(head).alias("skip"),
        F.length(text).alias("length"),
        (role == "assistant").alias("loss"),
    )
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))
    spans = F.aggregate(
        "turns",
        start,
        lambda done, t: F.struct(
            (done.at + F.length(t.piece)).alias("at"),
            F.when(
                t.loss,
                F.concat(done.spans, F.array(F.struct((done.at + t.skip).alias("start"), t.length.cast("long").alias("length")))),
            ).otherwise(done.spans).alias("spans"),
        ),
        lambda done: done.spans,
    )
    return turns.select("conv_id", F.array_join(F.col("turns.piece"), "").alias("formatted"), spans.alias("loss_spans"))


def format_chats(events: DataFrame) -> DataFrame:
    """Fold a log and render its conversations; see `fold_events` and `render`."""
    return render(fold_events(events))


def read_back(formatted: str = "formatted") -> Column:
    """Turns of a rendered conversation: an array of (role, text)."""
    pieces = F.split(F.col(formatted), END, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.instr(piece, BODY)
        role = F.substr(piece, F.lit(len(TURN + HEAD) + 1), body - len(TURN + HEAD) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(piece, body + len(BODY))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(F.col(formatted), (s.start + 1).cast("int"), s.length.cast("int")))), ""
    )


def events_of(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """Event log of finished conversations (conv_id, turn, role, text).

    Each row is one message, numbered by (turn, role, text), so repeated rows stay
    repeated messages.  An assistant text is streamed twice, with a regeneration in
    between; any other text is streamed after an edit that clears a first draft.
    """
    text = F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", F.row_number().over(order).alias("message"), "role", text.alias("text"))
    parts = F.transform(
        F.sequence(F.lit(0), F.floor(F.length("text") / delta_chars).cast("int")),
        lambda i: F.substr(F.col("text"), i * delta_chars + 1, F.lit(delta_chars)),
    )
    first = F.col("message").cast("long") * (1 << 32)
    event = lambda place, kind, body: F.struct((first + place).alias("seq"), F.lit(kind).alias("kind"), body.alias("text"))
    reset = F.when(F.col("role") == "assistant", event(2, "regenerate", F.lit(""))).otherwise(event(2, "edit", F.lit("")))
    log = F.concat(
        F.array(event(0, "open", F.lit("")), event(1, "delta", F.get(F.col("parts"), F.lit(0))), reset),
        F.transform("parts", lambda part, i: event(i + 3, "delta", part)),
    )
    rows = rows.withColumn("parts", parts).select("conv_id", "message", "role", F.explode(log).alias("e"))
    return rows.select("conv_id", "message", "role", "e.seq", "e.kind", "e.text")


#: A conversation whose texts hold marks of the template.
PLANTED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat_format(spark, folder: str) -> DataFrame:
    """Digests, read back from the rendered conversations."""
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    chats = format_chats(events_of(rows.unionByName(planted)))
    chats = chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_back().alias("turns"), loss_text().alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP3_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
marked AS (
  SELECT *, regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g') AS body
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<s>[INST]' || role || '[/INST]' || body || '</s>')) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
