r"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own, with all turns before it as context and only that reply trainable.

A turn becomes a piece of text, `<turn ROLE>\n TEXT \n</turn>\n` without the blanks, and a conversation
the stream of its pieces, a row a turn with the place where it starts.  An example is the stream's whole
text up to the end of its reply, with the code points that are trained on.  Examples of one conversation
share their beginnings, so all of them together grow with the square of its turns; what moves between
tasks doesn't until a conversation is longer than a segment: each turn goes to its own segment and to
those after it, where the examples of the segment's replies are made one after the other.

Within texts a backslash goes into whatever looks like a mark, after the `<` or `</` (and before any
backslashes there); reading back takes one out, so every text comes back as it was.  Roles have %, <, >
and line ends as per cent codes.

Null texts and roles are empty, a null conv_id is a conversation of its own.  Turns are in the order of
`turn`, nulls first; rows of one turn by role, then text.  Rows that repeat are turns of their own.  A
conversation without a reply has a stream and no examples; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaria.llm.turns import by_key, in_order, runs_of

TARGET = "assistant"
_CODES = (("%", "%25"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A"))


def escaped(text: Column) -> Column:
    """A text in which nothing looks like a mark."""
    return F.regexp_replace(text, r"(</?)(\\*turn)", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(</?)\\(\\*turn)", "$1$2")


def _replaced(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def piece(role: Column, text: Column) -> Column:
    """A turn as it stands in a stream."""
    return F.concat(F.lit("<turn "), _replaced(role, _CODES), F.lit(">\n"), escaped(text), F.lit("\n</turn>\n"))


def turns_of(text: Column) -> Column:
    """The turns of a stream, an example or a piece: an array of (role, text)."""
    whole = F.filter(F.split(text, "</turn>\n", -1), lambda t: t != "")

    def read(t: Column) -> Column:
        head = F.locate(">", t)
        role = F.substring(t, F.lit(7), head - 7)
        return F.struct(_replaced(role, [(b, a) for a, b in reversed(_CODES)]).alias("role"), unescaped(F.substring(t, head + 2, F.length(t) - head - 2)).alias("text"))

    return F.transform(whole, read)


def stream(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, starts, piece, loss_from, loss_to) of conversations(conv_id, turn, role, text), a row a turn, from a written table.

    starts counts the stream's code points before the piece; loss_from and loss_to, as places in the
    stream, are the text of a reply and null for other turns.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )
    rows = rows.withColumn("piece", piece(F.col("role"), F.col("text"))).withColumn("chars", F.length("piece").cast("long"))
    found = in_order(rows, "conv_id", ("turn", "role", "text"), {"starts": "chars"}, "chat-stream")
    ends = F.col("starts") + F.col("chars") - len("\n</turn>\n")
    begins = ends - F.length(escaped(F.col("text")))
    reply = F.col("role") == TARGET
    return found.select("conv_id", "position", "starts", "piece", F.when(reply, begins).alias("loss_from"), F.when(reply, ends).alias("loss_to"))


#: Code points of a conversation whose examples one task makes.
SEGMENT = 1 << 20


def examples(stream: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, position, text, loss_from, loss_to): for each reply the example that ends with it, all turns before it included.

    text is the stream's first code points up to the reply's end, position the reply's among the turns.
    A conversation of many segments is parted over as many tasks, each with the turns up to its own.
    """
    rows = stream.withColumn("its_segment", F.floor(F.col("starts") / segment))
    last = rows.where("loss_from IS NOT NULL AND its_segment > 0").groupBy(F.col("conv_id").alias("its_conv")).agg(F.max("its_segment").alias("last"))
    sent = rows.join(last, F.col("conv_id").eqNullSafe(F.col("its_conv")), "left").drop("its_conv")
    sent = sent.select("*", F.explode(F.sequence("its_segment", F.greatest("its_segment", "last"))).alias("of"))
    before = Window.partitionBy("conv_id", "of").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = sent.withColumn("pieces", F.collect_list("piece").over(before)).where("loss_from IS NOT NULL AND of = its_segment")
    return whole.select("conv_id", "position", F.array_join("pieces", "").alias("text"), "loss_from", "loss_to")


def trained(example: str = "text") -> Column:
    """What an example is trained on, as it was before it was escaped."""
    return unescaped(F.substring(F.col(example), (F.col("loss_from") + 1).cast("int"), (F.col("loss_to") - F.col("loss_from")).cast("int")))


def texts(stream: DataFrame, examples: DataFrame) -> DataFrame:
    """(conv_id, position, text, loss_from, loss_to) of the examples of a stream."""
    return examples.select("conv_id", "position", "text", "loss_from", "loss_to")


def digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the written stream and its examples.

    A digest runs over a conversation from its first turn to its last, so its pieces pass through one
    task, one row at a time.
    """
    written = stream(conversations)
    empty = F.lit("")
    turns = written.select("conv_id", F.lit(0).alias("kind"), "position", F.length("piece").cast("long").alias("chars"), F.inline(turns_of(F.col("piece"))))
    replies = examples(written).select("conv_id", F.lit(1).alias("kind"), "position", F.lit(0).cast("long").alias("chars"), empty.alias("role"), trained().alias("text"))
    names = "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()

    def read(batches):
        now, rows = (), []

        def done():
            return now[0], n, turns_hash.hexdigest(), n_loss, loss_hash.hexdigest(), n_chars

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))

        for conv, kind, _, chars, role, text in runs_of(batches):
            if now != (conv,):
                if now:
                    rows.append(done())
                now, n, n_loss, n_chars, turns_hash, loss_hash = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                if len(rows) == 10_000:
                    yield out()
                    rows.clear()
            if kind:
                n_loss += len(text)
                loss_hash.update(text.encode())
            else:
                n, n_chars = n + 1, n_chars + chars
                turns_hash.update(f"{role}\n{text}\n".encode())
        if now:
            rows.append(done())
            yield out()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return by_key(turns.unionByName(replies), "conv_id", "kind", "position").mapInArrow(read, schema)
