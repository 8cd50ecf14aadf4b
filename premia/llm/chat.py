"""Chat formatting by event-sourced reconstruction, in DataFrame functions alone.

A chat log is a table of events ``(conv_id, seq, kind, msg, role, text)``. ``reconstruct`` partitions
the log by conversation and message, orders it by ``seq`` and folds it into final messages:

* ``message`` and ``regenerate`` start a new version of message ``msg`` (role and text), ``edit``
  replaces its text (and its role where one is given);
* ``delta`` appends its text to the version in force at its ``seq``;
* an ``edit`` or ``regenerate`` of message m drops every later message (greater ``msg``) whose
  latest version is older than it, as a chat shows after such a rewrite;
* deltas before a message's latest version are overwritten by it; a message of deltas alone
  starts from an empty text and an empty role.

``render`` writes each conversation as one text in a template of its own: every turn is
``<s>[role]text</s>`` and a line feed, with ``&``, ``<``, ``[`` and ``]`` inside roles and texts
written as ``&amp;``, ``&lt;``, ``&#91;`` and ``&#93;``; so no text can make or close a turn, and
``unescape`` gives every text back. Beside the text it gives the loss mask: the code-point spans
(0-based start, exclusive end) of every assistant text. ``read_back`` parses a rendered table
again into turns, and the texts under the mask.

Defined results: a null text or role is empty; null ``seq`` comes first, ties of ``seq`` keep the
order of kind (versions before edits before deltas), then text; rows without ``conv_id`` are one
conversation with a null id; a conversation whose messages were all dropped has no row; an empty log
gives an empty table; very long texts stay whole (Spark strings, no cut). Extra columns of the log
are not carried; names the functions use internally start with ``_chat_`` and cannot clash.
A conversation's messages are folded and joined within one task: a text of one conversation is
one value, which is what a training example is.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

# The template's marks and the escapes of the characters that start them.
TURN_OPEN, ROLE_CLOSE, TURN_CLOSE = "<s>[", "]", "</s>\n"
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;")]
ASSISTANT = "assistant"
_VERSION_KINDS = ("message", "regenerate")
_KIND_ORDER = {"message": 0, "regenerate": 0, "edit": 1, "delta": 2}


def escape(column):
    """``column`` with the template's characters escaped (``&`` first, so it reverses)."""
    for plain, written in ESCAPES:
        column = F.replace(column, F.lit(plain), F.lit(written))
    return column


def unescape(column):
    """The inverse of ``escape`` (``&`` last)."""
    for plain, written in reversed(ESCAPES):
        column = F.replace(column, F.lit(written), F.lit(plain))
    return column


def messages_as_events(turns):
    """Rows ``(conv_id, turn, role, text)`` as one ``message`` event each, ordered by turn (null
    first), ties by role and text; ``msg`` and ``seq`` are the row's place in its conversation."""
    order = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    place = F.row_number().over(order).cast("bigint")
    return turns.select("conv_id", place.alias("seq"), F.lit("message").alias("kind"),
                        place.alias("msg"), "role", "text")


def reconstruct(events):
    """Final messages ``(conv_id, msg, role, text)`` of an event log, folded as the module says."""
    e = events.select(
        "conv_id", "msg", "kind", F.coalesce("text", F.lit("")).alias("_chat_text"),
        F.col("role").alias("_chat_role"), F.col("seq").alias("_chat_seq"),
        F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in _KIND_ORDER.items()],
                   F.lit(3)).alias("_chat_rank"))
    order = Window.partitionBy("conv_id", "msg").orderBy(
        F.col("_chat_seq").asc_nulls_first(), "_chat_rank", "_chat_text")
    version_start = F.col("kind").isin(*_VERSION_KINDS)
    # The place of each event in its message, and the place of the version it belongs to.
    e = e.withColumn("_chat_at", F.row_number().over(order))
    e = e.withColumn("_chat_version", F.max(F.when(version_start, F.col("_chat_at"))).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    e = e.withColumn("_chat_latest", F.max(F.when(version_start, F.col("_chat_at"))).over(
        Window.partitionBy("conv_id", "msg")))
    # Only events of the latest version (or all, if none started one) make the final message.
    live = e.where(F.col("_chat_latest").isNull()
                   | (F.coalesce("_chat_version", F.lit(0)) == F.col("_chat_latest")))
    part = F.struct("_chat_at", "kind", "_chat_text", "_chat_role")
    folded = live.groupBy("conv_id", "msg").agg(
        F.sort_array(F.collect_list(part)).alias("_chat_parts"),
        F.max(F.when(version_start, F.col("_chat_seq"))).alias("_chat_born"),
        F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("_chat_seq")))
        .alias("_chat_rewritten"))
    # Fold: a version or edit sets the text, a delta appends to it.
    text = F.aggregate(
        "_chat_parts", F.lit(""),
        lambda acc, p: F.when(p["kind"] == "delta", F.concat(acc, p["_chat_text"]))
        .when(p["kind"].isin("message", "regenerate", "edit"), p["_chat_text"]).otherwise(acc))
    role = F.aggregate(
        "_chat_parts", F.lit(None).cast("string"),
        lambda acc, p: F.when(p["kind"].isin("message", "regenerate", "edit")
                              & p["_chat_role"].isNotNull(), p["_chat_role"]).otherwise(acc))
    # A rewrite of an earlier message drops later messages born before it.
    earlier = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(
        Window.unboundedPreceding, -1)
    kept = folded.withColumn("_chat_cut", F.max("_chat_rewritten").over(earlier)).where(
        F.col("_chat_cut").isNull() | (F.col("_chat_born") > F.col("_chat_cut")))
    return kept.select("conv_id", "msg", F.coalesce(role, F.lit("")).alias("role"),
                       text.alias("text"))


def render(messages):
    """One row a conversation: ``conv_id``, ``n_turns``, ``formatted`` and ``mask`` (spans of
    assistant texts in ``formatted``), messages in ``msg`` order."""
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(TURN_OPEN), role, F.lit(ROLE_CLOSE))
    piece = F.concat(head, text, F.lit(TURN_CLOSE))
    order = Window.partitionBy("conv_id").orderBy("msg")
    rows = messages.select(
        "conv_id", "msg", piece.alias("_chat_piece"), F.length(head).alias("_chat_head"),
        F.length(text).alias("_chat_len"), (F.col("role") == ASSISTANT).alias("_chat_loss"))
    rows = rows.withColumn("_chat_offset", F.coalesce(F.sum(F.length("_chat_piece")).over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.col("_chat_offset") + F.col("_chat_head")
    span = F.when(F.col("_chat_loss"), F.struct(start.cast("bigint").alias("start"),
                                                (start + F.col("_chat_len")).cast("bigint").alias("end")))
    grouped = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("msg", "_chat_piece", span.alias("span"))))
        .alias("_chat_turns"))
    return grouped.select(
        "conv_id", F.size("_chat_turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("_chat_turns", lambda t: t["_chat_piece"]), "").alias("formatted"),
        F.filter(F.transform("_chat_turns", lambda t: t["span"]), lambda s: s.isNotNull())
        .alias("mask"))


def read_back(rendered):
    """Turns and masked texts parsed again from ``formatted`` and ``mask``: ``turns`` (array of
    role and text, unescaped) and ``loss_text`` (every masked span unescaped, joined as is)."""
    pieces = F.split(F.col("formatted"), TURN_CLOSE, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)  # what follows the last turn's close is empty
    cut = lambda p: F.instr(p, ROLE_CLOSE)  # noqa: E731 - escaped roles hold no ']'
    turns = F.transform(pieces, lambda p: F.struct(
        unescape(F.substring(p, len(TURN_OPEN) + 1, cut(p) - len(TURN_OPEN) - 1)).alias("role"),
        unescape(F.substring(p, cut(p) + 1, F.length(p))).alias("text")))
    loss = F.array_join(F.transform("mask", lambda s: unescape(
        F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))),
        "")
    return rendered.select("*", turns.alias("turns"), loss.alias("loss_text"))


def digests(read):
    """The digest columns of a read-back table."""
    turns = F.array_join(F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
