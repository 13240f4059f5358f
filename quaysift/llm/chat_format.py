"""Chat formatting: event logs fold into final messages, which a reversible template renders. DataFrame functions only.

Template, per message::

    ### Role: text</turn>

and a line feed. Inside roles and texts a backslash becomes ``\\b``, ``###`` becomes ``\\h`` and ``</turn>`` becomes
``\\t``; in roles a colon becomes ``\\c`` too. So the marks stand at the ends of turns only, and what was escaped
comes back by replacing the codes, the backslash last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEAD, COLON, END = "### ", ": ", "</turn>\n"
CODES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t")]
ROLE_CODES = [*CODES, (":", "\\c")]


def escape(c: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    for plain, code in codes:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    for plain, code in reversed(codes):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, turn, nth, role, text`` of ``events(conv_id, seq, kind, turn, role, text)``.

    Kinds: ``message`` adds a message at its turn (a turn may have several, ``nth`` counts them); ``delta``
    appends to the turn's latest message; ``edit`` replaces its text and ``regenerate`` clears it to what the
    event itself carries, and both take back everything at later turns that came before. A delta, edit or
    regeneration of a turn without a message begins one (``nth`` 0). Equal ``seq`` are ordered by kind, role and
    text; null texts and roles count as empty, an unknown or null kind as ``message``. Null conv_ids are one
    conversation, null turns come first. Each conversation is one key of the window, whose running frames
    keep no more than a row.
    """
    kind = F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise("message")
    e = events.select("conv_id", "seq", kind.alias("kind"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["seq", "kind", "role", "text"]
    resets = F.col("kind").isin("edit", "regenerate")
    later = W.partitionBy("conv_id").orderBy(*(F.desc(c) for c in order)).rowsBetween(W.unboundedPreceding, -1)
    turn = W.partitionBy("conv_id", "turn").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("back_to", F.min(F.when(resets, F.col("turn"))).over(later)).filter("back_to IS NULL OR turn IS NULL OR turn <= back_to")
    e = e.withColumn("nth", F.sum(F.when(F.col("kind") == "message", 1).otherwise(0)).over(turn))
    message = W.partitionBy("conv_id", "turn", "nth")
    e = e.withColumn("version", F.sum(F.when(resets, 1).otherwise(0)).over(message.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    last = e.withColumn("final", F.max("version").over(message))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("version") == F.col("final"), F.struct(*order)))), lambda x: x["text"]), "")
    return last.groupBy("conv_id", "turn", "nth").agg(F.coalesce(F.min_by("role", F.struct("version", "seq", "kind", "role", "text")), F.lit("")).alias("role"), text.alias("text"))


def format_conversations(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, segments``.

    ``messages(conv_id, turn, nth, role, text)`` are rendered in the order of turn, nth, role and text.
    ``formatted`` is the training text and ``segments`` the same text in pieces ``(text, loss)``: the loss mask
    covers the text of ``loss_role``'s messages, and nothing of the template.
    """
    m = messages.withColumn("n", F.coalesce("nth", F.lit(0)))
    head = F.concat(F.lit(HEAD), escape(F.coalesce("role", F.lit("")), ROLE_CODES), F.lit(COLON))
    body = escape(F.coalesce("text", F.lit("")))
    piece = F.struct("turn", "n", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), head.alias("head"), body.alias("body"))
    row = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("m"))
    segments = F.flatten(
        F.transform(
            "m",
            lambda x: F.array(
                F.struct(x["head"].alias("text"), F.lit(False).alias("loss")),
                F.struct(x["body"].alias("text"), (x["role"] == loss_role).alias("loss")),
                F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    row = row.select("conv_id", F.size("m").cast("long").alias("n_turns"), segments.alias("segments"))
    return row.select("conv_id", "n_turns", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse_formatted(formatted: Column) -> Column:
    """The messages ``array<struct<role, text>>`` that a formatted text holds."""
    parts = F.split(formatted, END)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    at = lambda p: F.instr(p, COLON)

    def turn(p: Column) -> Column:
        role = p.substr(F.lit(len(HEAD) + 1), at(p) - len(HEAD) - 1)
        text = p.substr(at(p) + len(COLON), F.length(p))
        return F.struct(unescape(role, ROLE_CODES).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


#: A conversation whose texts hold the template's own marks.
MARKED = r"\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of marked texts, digested from what is read back out of the formatted text."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    marked = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))))).alias("x"))
    marked = marked.select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("x.turn").cast(kinds["turn"]).alias("turn"), "x.role", F.lit(MARKED).alias("text"))
    events = table.unionByName(marked).select("*", F.col("turn").alias("seq"), F.lit("message").alias("kind"))
    done = format_conversations(fold_events(events)).withColumn("read", parse_formatted(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    turns = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    done = done.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return done.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP8_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c'))
    + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) + 4 + 2 + 8 AS chars FROM m)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
