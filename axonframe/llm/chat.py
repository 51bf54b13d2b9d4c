r"""Chat formatting by event-sourced reconstruction.

A log of events (conversation, sequence, message, kind, role, text) is folded into messages: `open` starts a message,
`delta` appends to it, `edit` sets its text, `regenerate` clears it for the deltas that follow, `retract` removes it.
Messages are rendered in the order in which they were opened.

A turn is rendered as `<turn>### Role: text</turn>` and a line feed. Inside roles and texts `\` becomes `\b`, `#`
becomes `\h` and `<` becomes `\l` (and `:` becomes `\c` in roles), so no mark can arise from content, and every escape
can be undone.

Defined cases: null texts and roles are empty; rows of equal turn keep apart, ordered by role, then text; null turns
come first; equal rows are turns of their own; an empty log gives no conversation. A null conversation id is an id like
another. Messages of any length are kept whole, but a conversation's rendering is one value, so it has to fit a row.
Other columns aren't read, whatever their names. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

OPEN, CLOSE = "<turn>### ", "</turn>\n"
#: Who is trained on.
LOSS_ROLE = "assistant"
CONTROL = (-7, r"\### Assistant: </turn> ok")
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escaped(text: Column, escapes: tuple = ESCAPES) -> Column:
    for raw, safe in escapes:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column, escapes: tuple = ESCAPES) -> Column:
    for raw, safe in reversed(escapes):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def as_events(turns: DataFrame) -> DataFrame:
    """Stored turns as a log: each row opens a message and is its one delta."""
    row = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = turns.select("conv_id", row.cast("long").alias("msg"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = F.array(F.struct(F.lit(0).alias("step"), F.lit("open").alias("kind")), F.struct(F.lit(1).alias("step"), F.lit("delta").alias("kind")))
    rows = rows.withColumn("e", F.explode(kinds))
    return rows.select("conv_id", (F.col("msg") * 2 + F.col("e.step")).alias("seq"), "msg", F.col("e.kind").alias("kind"), "role", F.when(F.col("e.kind") == "delta", F.col("text")).otherwise("").alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, opened, role, text): one row a message that stands at the end of the log.

    Only events after a message's last edit or regeneration matter, so a window finds that one and the deltas behind
    it are joined in sequence order; a conversation is never gathered here, only one message at a time.
    """
    whole = W.partitionBy("conv_id", "msg")
    last = F.max(F.when(F.col("kind").isin("edit", "regenerate", "open"), F.col("seq"))).over(whole)
    rows = events.withColumn("reset", F.coalesce(last, F.lit(-(1 << 62))))
    live = F.col("seq") >= F.col("reset")
    part = F.when(live & F.col("kind").isin("delta", "edit", "open"), F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))
    message = rows.groupBy("conv_id", "msg").agg(
        F.min("seq").alias("opened"),
        F.min_by("role", F.when(F.col("kind") == "open", F.col("seq"))).alias("role"),
        F.array_sort(F.collect_list(part)).alias("parts"),
        F.max(F.col("kind") == "retract").alias("gone"),
    )
    return message.where(~F.col("gone")).select("conv_id", "opened", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.col("parts.text"), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): loss lists (turn, start, length) in code points of a turn's rendering, turns from 0."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), ROLE_ESCAPES), F.lit(": "))
    body = escaped(F.col("text"))
    turn = F.struct("opened", F.concat(head, body, F.lit(CLOSE)).alias("turn"), F.when(F.lower("role") == LOSS_ROLE, F.length(head)).alias("start"), F.length(body).alias("chars"))
    rows = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    marks = F.transform("turns", lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), t["chars"].alias("chars")))
    return rows.select("conv_id", F.array_join(F.col("turns.turn"), "").alias("formatted"), F.filter(marks, lambda m: m["start"].isNotNull()).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, trained): what the rendering says, by its marks and loss spans alone."""
    pieces = F.split("formatted", CLOSE, -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def parsed(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(OPEN) + 1))
        cut = F.instr(inner, ": ")
        return F.struct(unescaped(F.substr(inner, F.lit(1), cut - 1), ROLE_ESCAPES).alias("role"), unescaped(F.substr(inner, cut + 2)).alias("text"))

    rows = formatted.withColumn("pieces", pieces)
    trained = F.transform("loss", lambda m: unescaped(F.substr(F.element_at(F.col("pieces"), m["turn"] + 1), m["start"] + 1, m["chars"])))
    return rows.select("conv_id", "formatted", F.transform("pieces", parsed).alias("turns"), F.array_join(trained, "").alias("trained"))


def query(spark, sf_dir: str) -> DataFrame:
    stored = common.pick(spark.read.parquet(f"{sf_dir}/conversations.parquet"), conv_id="conv_id", turn="turn", role="role", text="text")
    extra = spark.range(2).select(F.lit(CONTROL[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL[1]).alias("text"))
    turns = stored.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    rows = read_back(render(fold(as_events(turns))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.encode("trained", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM turns),
f AS (SELECT *, length(r) + (length(r) - length(replace(replace(replace(replace(r, '\', ''), '#', ''), '<', ''), ':', ''))) AS rc,
    2 * length(x) - length(replace(replace(replace(x, '\', ''), '#', ''), '<', '')) AS xc FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (lower(r) = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY i) FILTER (lower(r) = 'assistant'), '')) AS loss_sha256,
  sum(10 + rc + 2 + xc + 8)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
