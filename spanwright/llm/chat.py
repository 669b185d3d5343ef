"""Chat formatting: event-sourced reconstruction of conversations, then rendering with a loss mask.

A log of events (conversation, sequence number, message, kind, role, text) is folded into the
final messages: ``message`` starts a message, ``delta`` appends to it, ``edit`` replaces what it
says, ``regenerate`` discards it so that later deltas build it anew. Folding is associative: runs
of events are summed up as (was it reset, last role, text) and joined in sequence order, so a
message streamed in very many deltas, or a conversation of very many messages, is summed up in
chunks first and never sorted in one task.

Only DataFrame functions are used.

Defined cases: a null text or role counts as empty; an unknown kind counts as ``delta``; a delta
or edit without a message before it starts the message; events with equal sequence numbers are
ordered by kind, role and text; conversations with a null key form one conversation; an empty log
gives no rows; other columns are ignored. A conversation becomes one row, so one must fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The template. No "<" or "#" is left in escaped text, so the marks cannot be forged.
OPEN, HEAD_END, CLOSE = "### ", ":\n", "\n</turn>\n"
RESETS = ("message", "edit", "regenerate")
CHUNK = 256


def escape(text: Column) -> Column:
    r"""\ becomes \b, < becomes \l, # becomes \h; unescape() undoes it."""
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    r"""As escape(), and : becomes \c, so a role cannot end its own header."""
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def fold_events(log: DataFrame, conv: str = "conv_id", message: tuple[str, ...] = ("turn",), seq: str = "seq", kind: str = "kind", role: str = "role", text: str = "text") -> DataFrame:
    """Final messages (conv, *message, role, text) of an event log."""
    keys = [conv, *message]
    event = F.struct(F.col(seq).alias("s"), F.coalesce(F.col(kind), F.lit("delta")).alias("k"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def summed(items: Column, reset, told: str) -> Column:
        """(reset, role, text) of summed-up items in their order."""
        last = F.aggregate(F.transform(items, lambda x, i: F.when(reset(x), i).otherwise(F.lit(-1))), F.lit(-1), lambda a, b: F.greatest(a, b))
        kept = F.slice(items, F.greatest(last, F.lit(0)) + 1, F.greatest(F.size(items), F.lit(1)))
        named = F.filter(items, lambda x: x["r"] != "")
        return F.struct((last >= 0).alias("reset"), F.coalesce(F.get(named, F.size(named) - 1)["r"], F.lit("")).alias("r"), F.array_join(F.transform(kept, lambda x: x["t"]), "").alias("t")).alias(told)

    chunks = (
        log.select(*keys, event.alias("e"), F.floor(F.col(seq) / CHUNK).alias("_chunk"))
        .groupBy(*keys, "_chunk")
        .agg(F.sort_array(F.collect_list("e")).alias("e"))
        .select(*keys, "_chunk", summed(F.col("e"), lambda x: x["k"].isin(*RESETS), "m"))
    )
    whole = chunks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("_chunk").alias("c"), F.col("m.reset").alias("reset"), F.col("m.r").alias("r"), F.col("m.t").alias("t")))).alias("m"))
    return whole.select(*keys, summed(F.col("m"), lambda x: x["reset"], "m")).select(*keys, F.col("m.r").alias("role"), F.col("m.t").alias("text"))


def render(messages: DataFrame, conv: str = "conv_id", order: tuple[str, ...] = ("turn",), learn: str = "assistant") -> DataFrame:
    """One row a conversation: conv, formatted, loss_spans (start and end in code points, of the escaped texts of `learn`)."""
    head = F.concat(F.lit(OPEN), escape_role(F.coalesce("role", F.lit(""))), F.lit(HEAD_END))
    body = escape(F.coalesce("text", F.lit("")))
    pieces = messages.select(
        conv,
        F.floor(F.col(order[0]) / CHUNK).alias("_chunk"),  # null, and first, where the place is
        F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.concat(head, body, F.lit(CLOSE)).alias("f"), F.length(head).alias("h"), F.length(body).alias("b"), (F.coalesce("role", F.lit("")) == learn).alias("y")).alias("p"),
    )
    chunks = pieces.groupBy(conv, "_chunk").agg(F.sort_array(F.collect_list("p")).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    walked = F.aggregate(
        "p",
        start,
        lambda a, p: F.struct(
            (a["at"] + F.length(p["f"])).alias("at"),
            F.when(p["y"], F.concat(a["spans"], F.array(F.struct((a["at"] + p["h"]).alias("start"), (a["at"] + p["h"] + p["b"]).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    chunks = chunks.select(conv, "_chunk", F.array_join(F.transform("p", lambda p: p["f"]), "").alias("f"), walked.alias("w"))
    chunks = chunks.select(conv, F.struct(F.col("_chunk").alias("c"), F.col("f"), F.col("w.at").alias("n"), F.col("w.spans").alias("spans")).alias("c"))
    whole = chunks.groupBy(conv).agg(F.sort_array(F.collect_list("c")).alias("c"))
    moved = F.aggregate(
        "c",
        start,
        lambda a, c: F.struct((a["at"] + c["n"]).alias("at"), F.concat(a["spans"], F.transform(c["spans"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), (s["end"] + a["at"]).alias("end")))).alias("spans")),
    )
    return whole.select(conv, F.array_join(F.transform("c", lambda c: c["f"]), "").alias("formatted"), moved["spans"].alias("loss_spans"))


def read_back(rendered: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Parse what render() wrote: conv, turns (role, text), loss_text, formatted_chars."""
    blocks = F.filter(F.split("formatted", F.lit(CLOSE)), lambda b: b != "")
    head, mark = len(OPEN), len(HEAD_END)

    def parsed(block: Column) -> Column:
        end = F.instr(block, HEAD_END)
        return F.struct(unescape_role(F.substring(block, F.lit(head + 1), end - head - 1)).alias("role"), unescape(F.substring(block, end + mark, F.length(block))).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return rendered.select(conv, F.transform(blocks, parsed).alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


#: Code points of a streamed delta, and events of a message's rejected draft at most.
DELTA_CHARS, DRAFT_DELTAS = 48, 3


def transcript_log(conversations: DataFrame) -> DataFrame:
    """Rows of finished turns as the log of a session that ended in them: conv_id, turn, copy, seq, kind, role, text.

    Each turn starts with a ``message`` of its role and a first piece, and streams the rest in deltas of DELTA_CHARS.
    Before that, a third of the turns stream a draft that a ``regenerate`` throws away, and a third say something else
    that an ``edit`` replaces by the first piece. Rows that repeat a turn stay messages of their own (copy). Rows of the log
    are in no order.
    """
    copies = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("copy", F.row_number().over(copies))
    said = F.coalesce("text", F.lit(""))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(said) / DELTA_CHARS).cast("int"), F.lit(1)) - 1), lambda k: F.substring(said, k * DELTA_CHARS + 1, F.lit(DELTA_CHARS)))
    event = lambda kind, role, text: F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    no_role, role = F.lit(None).cast("string"), F.col("role")
    deltas = lambda xs: F.transform(xs, lambda x: event("delta", no_role, x))
    draft = F.transform(F.slice(pieces, 1, DRAFT_DELTAS), lambda x: F.reverse(x))
    course = F.pmod(F.xxhash64("conv_id", "turn", "copy"), F.lit(3))
    streamed = F.concat(F.array(event("message", role, pieces[0])), deltas(F.slice(pieces, F.lit(2), F.size(pieces))))
    redone = F.concat(F.array(event("message", role, F.lit(""))), deltas(draft), F.array(event("regenerate", no_role, no_role)), deltas(pieces))
    edited = F.concat(F.array(event("message", role, F.lit("draft"))), deltas(draft), F.array(event("edit", no_role, pieces[0])), deltas(F.slice(pieces, F.lit(2), F.size(pieces))))
    events = F.when(course == 0, streamed).when(course == 1, redone).otherwise(edited)
    return rows.select("conv_id", "turn", "copy", F.posexplode(events).alias("seq", "e")).select("conv_id", "turn", "copy", F.col("seq").cast("long").alias("seq"), "e.kind", "e.role", "e.text")
