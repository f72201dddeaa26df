"""Operator 6 [native]: chat formatting with Spark expressions only.

Turns are ordered by (turn, role, text) and collected as structs, which are sorted and joined. Adjacent
turns of one role form one block:

    <|start|>role<|text|>text<|next|>text<|end|>

``<`` and ``\\`` inside texts and roles are written ``\\l`` and ``\\b``, so no text holds a control
string, and reading back is exact. The loss mask names the texts of the ``assistant`` role, as code point
spans of the formatted string (``start``, ``size``) with their byte spans. Blocks, pieces and spans come from one
aggregation over the sorted array; it runs over groups of ``GROUP`` turns, whose starts are summed after it, so that appending to
arrays stays cheap in a long conversation. A conversation is one output string, so its rows meet in one task.

Null texts and roles read as empty; rows without conv_id are one conversation with a null id. Turns with
equal numbers are ordered by role and text; repeated rows are repeated turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template and the trained role.
START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
TRAINED = "assistant"

GROUP = 256  # turns that one aggregation appends to an array


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _merged(turns: Column, group: Column) -> Column:
    """The ``GROUP`` turns of the sorted array from ``group * GROUP`` on, by one array aggregation: a turn of the role before
    it goes on with its block, another closes that block and opens its own. ``pieces`` of the formatted string, their
    ``chars`` and ``bytes``, and ``spans`` of the trained texts from the group's start."""
    first = group * GROUP
    before = F.when(group > 0, F.get(turns, first - 1)["role"])
    span = "array<struct<start:bigint,size:bigint,byte_start:bigint,byte_size:bigint>>"
    empty = F.struct(before.alias("role"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("bytes"),
                     F.array().cast("array<string>").alias("pieces"), F.array().cast(span).alias("spans"))

    def step(done: Column, t: Column) -> Column:
        opening = F.concat(F.lit(START), t["role"], F.lit(TEXT))
        lead = (F.when(done["role"].isNull(), opening).when(done["role"] == t["role"], F.lit(NEXT))
                .otherwise(F.concat(F.lit(END), opening)))
        chars, size = done["chars"] + F.char_length(lead), F.char_length(t["text"]).cast("long")
        octets, byte_size = done["bytes"] + F.octet_length(lead), F.octet_length(t["text"]).cast("long")
        here = F.array(F.struct(chars.alias("start"), size.alias("size"), octets.alias("byte_start"), byte_size.alias("byte_size")))
        return F.struct(t["role"].alias("role"), (chars + size).alias("chars"), (octets + byte_size).alias("bytes"),
                        F.concat(done["pieces"], F.array(F.concat(lead, t["text"]))).alias("pieces"),
                        F.when(t["role"] == TRAINED, F.concat(done["spans"], here)).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(F.slice(turns, first + 1, GROUP), empty, step)


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask`` with one row per conversation of ``rows(conv_id, turn, role, text)``."""
    x = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                    escape(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"),
                    escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    conv = x.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("turns") - 1) / GROUP).cast("int")), lambda g: _merged(F.col("turns"), g))
    zero = F.struct(F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("bytes"))
    starts = F.aggregate("groups", F.array(zero), lambda done, g: F.concat(done, F.array(F.struct(
        (F.element_at(done, -1)["chars"] + g["chars"]).alias("chars"), (F.element_at(done, -1)["bytes"] + g["bytes"]).alias("bytes")))))
    moved = F.transform("groups", lambda g, i: F.transform(g["spans"], lambda s: F.struct(
        (s["start"] + F.get(F.col("starts"), i)["chars"]).alias("start"), s["size"].alias("size"),
        (s["byte_start"] + F.get(F.col("starts"), i)["bytes"]).alias("byte_start"), s["byte_size"].alias("byte_size"))))
    pieces = F.flatten(F.transform("groups", lambda g: g["pieces"]))
    return (conv.withColumn("groups", groups).withColumn("starts", starts)
            .select("conv_id", F.concat(F.array_join(pieces, ""), F.lit(END)).alias("formatted"), F.flatten(moved).alias("loss_mask")))


def read_turns(formatted: Column) -> Column:
    """Turns read back from a formatted string: array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.split(F.substring(b, len(START) + 1, 2147483647), r"<\|text\|>"))
    said = F.transform(parts, lambda p: F.struct(unescape(F.element_at(p, 1)).alias("role"),
                                                 F.split(F.element_at(p, 2), r"<\|next\|>").alias("texts")))
    return F.flatten(F.transform(said, lambda s: F.transform(
        s["texts"], lambda t: F.struct(s["role"].alias("role"), unescape(t).alias("text")))))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The text under the loss mask, unescaped."""
    raw = F.encode(formatted, "UTF-8")
    return F.array_join(F.transform(mask, lambda m: unescape(
        F.substring(raw, (m["byte_start"] + 1).cast("int"), m["byte_size"].cast("int")).cast("string"))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from ``format_conversations``."""
    x = (formatted.withColumn("turns", read_turns(F.col("formatted")))
         .withColumn("loss", read_loss(F.col("formatted"), F.col("loss_mask"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return x.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
                    F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
                    F.char_length("formatted").cast("long").alias("formatted_chars"))
