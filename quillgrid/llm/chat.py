"""Chat formatting from event logs.

A log holds what a chat service recorded: streamed pieces of a message, edits,
and regenerations that throw away an earlier answer. Events are folded into
final messages, which are rendered into one training text per conversation
together with a loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The template's marks, and their escaped spellings inside texts.
TURN_START = "### "
TURN_END = "</turn>\n"
ROLE_END = ": "
# Backslashes first when writing, last when reading: each escape is a backslash
# and one letter, so no replacement can read across two of them.
ESCAPES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e")]
ROLE_ESCAPES = ESCAPES + [(":", "\\c")]


def escape(text: Column, role: bool = False) -> Column:
    for plain, written in ROLE_ESCAPES if role else ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for plain, written in reversed(ROLE_ESCAPES if role else ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, message, role, text`` of a log.

    ``events`` has ``conv_id, seq, message, kind, role, text``; ``message`` is
    the place of the message in its conversation. In order of ``seq`` within
    each message, ``start`` and ``regenerate`` empty the text, ``edit`` sets
    it, ``delta`` appends to it. Equal ``seq`` are ordered by kind, role and
    text. The role is that of the last start (none: empty). Null texts and
    roles are empty; null ``conv_id`` form one conversation, null ``message``
    one message of it, which comes first; null ``seq`` come first; other kinds
    change nothing. No unbounded group meets before the fold: a message's own
    events do.
    """
    row = F.struct(
        "seq",
        "kind",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    log = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(row)).alias("log"))
    # places, not seq, tell what comes after the last reset: seq may be tied
    resets = F.transform("log", lambda e, i: F.when(e["kind"].isin("start", "regenerate", "edit"), i).otherwise(-1))
    last = F.array_max("resets")
    after = F.filter(
        F.slice(F.col("log"), last + 2, F.greatest(F.size("log") - last - 1, F.lit(0))),
        lambda e: e["kind"] == "delta",
    )
    base = F.when((last >= 0) & (F.get("log", last)["kind"] == "edit"), F.get("log", last)["text"]).otherwise("")
    starts = F.filter("log", lambda e: e["kind"] == "start")
    return log.withColumn("resets", resets).select(
        "conv_id",
        "message",
        F.coalesce(F.try_element_at(starts, F.lit(-1))["role"], F.lit("")).alias("role"),
        F.concat(base, F.array_join(F.transform(after, lambda e: e["text"]), "")).alias("text"),
    )


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One text per conversation: ``conv_id, formatted, turns``.

    ``turns`` tells for each turn where its escaped text starts and ends in
    ``formatted`` (code points, end exclusive) and whether it is under the loss
    mask, which holds for the roles of ``learn``. Messages come in order of
    ``message``, ties by role and text; repeated rows stay. A conversation is
    one string, so its messages meet in one row; offsets are summed before.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(TURN_START), escape(role, role=True), F.lit(ROLE_END))
    parts = messages.select(
        "conv_id", "message", role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body")
    )
    order = W.partitionBy("conv_id").orderBy("message", "role", "text")
    length = F.char_length("head") + F.char_length("body") + F.lit(len(TURN_END))
    parts = parts.withColumn("place", F.row_number().over(order)).withColumn(
        "stop", F.sum(length.cast("bigint")).over(order.rowsBetween(W.unboundedPreceding, 0))
    )
    end = F.col("stop") - len(TURN_END)
    turn = F.struct(
        "place",
        F.concat("head", "body", F.lit(TURN_END)).alias("piece"),
        F.struct(
            (end - F.char_length("body")).alias("start"), end.alias("end"), F.col("role").isin(*learn).alias("loss")
        ).alias("turn"),
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("all"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("all", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("all", lambda t: t["turn"]).alias("turns"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, messages``: roles, texts and loss flags read from ``formatted``.

    ``messages`` is an array of ``(role, text, loss)`` in order. The text is cut
    at the turn marks only, which escaping keeps out of texts and roles.
    """
    pieces = F.split("formatted", TURN_END, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    cut = lambda p: F.instr(p, F.lit(":"))  # noqa: E731 - a role has none
    message = lambda p, t: F.struct(
        unescape(F.substring(p, F.lit(len(TURN_START) + 1), cut(p) - 1 - len(TURN_START)), role=True).alias("role"),
        unescape(F.substring(p, cut(p) + F.lit(len(ROLE_END)), F.char_length(p))).alias("text"),
        t["loss"].alias("loss"),
    )
    return formatted.select("conv_id", "formatted", F.zip_with(pieces, "turns", message).alias("messages"))


def format_chats(events: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Fold a log and render it: ``conv_id, formatted, turns``; see the two steps."""
    return render(fold_events(events), learn)


def events_of(conversations: DataFrame) -> DataFrame:
    """A log that a chat service could have recorded for finished conversations.

    Every text arrives in three streamed pieces. A third of the assistant's
    messages were regenerated after a wrong draft, a third of the others were
    edited. Rows are ordered by turn, ties by role and text; null texts and
    roles are empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("message", F.row_number().over(order)).withColumn(
        "change", F.pmod(F.xxhash64("conv_id", "message"), F.lit(3))
    )
    step = F.floor(F.char_length("text") / 3).cast("int")
    piece = lambda a, n=None: F.substring("text", a, n if n is not None else F.char_length("text"))
    event = lambda k, kind, t: F.struct(
        F.lit(k).alias("step"), F.lit(kind).alias("kind"), t.cast("string").alias("text")
    )
    draft = [event(1, "delta", F.reverse("text")), event(2, "delta", F.col("text"))]
    streamed = F.array(
        event(4, "delta", piece(F.lit(1), step)),
        event(5, "delta", piece(step + 1, step)),
        event(6, "delta", piece(2 * step + 1)),
    )
    wrong = F.array(*draft, event(3, "regenerate", F.lit(None)))
    edited = F.array(*draft, event(3, "edit", piece(F.lit(1), step)))
    stream = (
        F.when((F.col("change") == 0) & (F.col("role") == "assistant"), F.concat(wrong, streamed))
        .when(F.col("change") == 0, F.concat(edited, F.slice(streamed, 2, 2)))
        .otherwise(streamed)
    )
    log = rows.select(
        "conv_id",
        "message",
        "role",
        F.explode(F.concat(F.array(event(0, "start", F.lit(None))), stream)).alias("event"),
    )
    return log.select(
        "conv_id",
        (F.col("message") * 8 + F.col("event.step")).cast("bigint").alias("seq"),
        F.col("message").cast("bigint").alias("message"),
        F.col("event.kind").alias("kind"),
        F.when(F.col("event.kind") == "start", F.col("role")).alias("role"),
        F.col("event.text").alias("text"),
    )
