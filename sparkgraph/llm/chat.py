"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted, adjacent turns of one role are
merged by an array aggregation, and the blocks are concatenated:

    <role>\\n text </turn>\\n          a block of one turn
    <role>\\n text <next> text </turn>\\n   a block of several turns

(without the blanks shown around texts and marks). Inside roles and texts ``&``
and ``<`` are written ``&amp;`` and ``&lt;``, and in roles ``>`` as ``&gt;``, so
no control string can occur there and :func:`parse` gives the turns back
unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SHUT, NEXT, END = "<", ">\n", "<next>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("&gt;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&gt;"), F.lit(">")))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row for each conversation: ``conv_id``, ``formatted`` and ``loss_spans``.

    ``loss_spans`` are [start, end) in code points of ``formatted`` around each
    text of the role ``trained``: its marks and the role lines lie outside.
    Turns are taken in the order of ``order``, ties by role and text; a null
    order comes first, null roles and texts are empty, and repeated rows are
    repeated turns. Rows without a key are one conversation. A conversation is
    one output row, so its turns meet in one task; nothing larger does. Work
    grows as its turns to the power of 1.5.
    """
    turn = F.struct(
        F.col(order).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    chats = turns.groupBy(F.col(key).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    places = F.sequence(F.lit(0), F.size("turns") - 1)
    # A turn opens a block where its role differs from the one before, and closes it likewise.
    pieces = F.transform(
        places,
        lambda i: F.struct(
            F.when(
                (i > 0) & (F.get("turns", i - 1)["role"] == F.get("turns", i)["role"]), F.lit(NEXT)
            ).otherwise(F.concat(F.lit(OPEN), escape_role(F.get("turns", i)["role"]), F.lit(SHUT))).alias("head"),
            escape(F.get("turns", i)["text"]).alias("body"),
            F.when(
                (i < F.size("turns") - 1) & (F.get("turns", i + 1)["role"] == F.get("turns", i)["role"]), F.lit("")
            ).otherwise(F.lit(END)).alias("tail"),
            (F.get("turns", i)["role"] == trained).alias("loss"),
        ),
    )
    chats = chats.select("conv_id", pieces.alias("pieces"))
    sizes = F.transform("pieces", lambda p: F.struct(F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), F.length(p["tail"]).alias("tail"), p["loss"].alias("loss")))
    chats = chats.withColumn("sizes", sizes).withColumn("parts", F.transform(_slices(F.col("sizes")), _spans)).withColumn("starts", _starts(F.col("parts")))
    shifted = lambda part, i: F.transform(part["spans"], lambda s: F.struct((s["start"] + F.get("starts", i)).alias("start"), (s["end"] + F.get("starts", i)).alias("end")))
    spans = F.flatten(F.transform("parts", shifted))
    formatted = F.concat_ws("", F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])))
    return chats.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def _slices(array: Column) -> Column:
    """An array in pieces of about the root of its size, so that work within pieces and over pieces grows as size to 1.5."""
    size = F.greatest(F.ceil(F.sqrt(F.size(array))).cast("int"), F.lit(1))
    empty = F.filter(F.array(array), lambda x: F.lit(False))
    return F.when(F.size(array) > 0, F.transform(F.sequence(F.lit(0), ((F.size(array) - 1) / size).cast("int")), lambda i: F.slice(array, i * size + 1, size))).otherwise(empty)


def _spans(sizes: Column) -> Column:
    """The spans under the loss mask in some pieces, counted from their first, and how long they are."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda done, p: F.struct(
            (done["at"] + p["head"] + p["body"] + p["tail"]).alias("at"),
            F.when(
                p["loss"],
                F.concat(done["spans"], F.array(F.struct((done["at"] + p["head"]).alias("start"), (done["at"] + p["head"] + p["body"]).alias("end")))),
            ).otherwise(done["spans"]).alias("spans"),
        ),
    )


def _starts(parts: Column) -> Column:
    """Where each part starts."""
    return F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda done, p: F.struct((done["at"] + p["at"]).alias("at"), F.concat(done["starts"], F.array(done["at"])).alias("starts")),
        lambda done: done["starts"],
    )


def parse(chats: DataFrame) -> DataFrame:
    """Read the output of :func:`format_chats` back: it gains ``turns`` (structs of role and text) and ``loss_texts``.

    ``turns`` come from ``formatted`` alone, ``loss_texts`` from what it holds
    inside ``loss_spans``.
    """
    blocks = F.filter(F.split("formatted", F.lit(END), -1), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substr(b, F.instr(b, F.lit(SHUT)) + F.lit(len(SHUT))), F.lit(NEXT), -1),
                lambda t: F.struct(
                    unescape_role(F.substr(b, F.lit(len(OPEN) + 1), F.instr(b, F.lit(SHUT)) - F.lit(len(OPEN) + 1))).alias("role"),
                    unescape(t).alias("text"),
                ),
            ),
        )
    )
    # A place in a string is found by counting from its start, so stretches are cut out first, and texts from these.
    stretch = F.transform(
        _slices(F.col("loss_spans")),
        lambda s: F.struct(s.alias("spans"), F.substr("formatted", F.get(s, F.lit(0))["start"] + 1, F.element_at(s, -1)["end"] - F.get(s, F.lit(0))["start"]).alias("text")),
    )
    cut = lambda x: F.transform(x["spans"], lambda s: unescape(F.substr(x["text"], s["start"] - F.get(x["spans"], F.lit(0))["start"] + 1, s["end"] - s["start"])))
    read = chats.withColumns({"turns": turns, "__stretches": stretch})
    return read.withColumn("loss_texts", F.flatten(F.transform("__stretches", cut))).drop("__stretches")
