"""Chat formatting: every assistant turn becomes an example of its own.

Prefix-target expansion: the context of an example is the formatted conversation
up to the reply, and only the reply is trainable: the loss mask covers
``start .. end`` of its text. The examples of a conversation of ``n`` turns have
``n`` squared characters between them, so their texts are made row by row from the
conversation and never shuffled. Everything is built from DataFrame functions.

Template of a turn: ``<turn ROLE>TEXT</turn>`` and a line feed. Inside role and
text ``\\``, ``<`` and ``>`` are written ``\\s``, ``\\l`` and ``\\g``, so that no
text can look like a mark and the escape can be undone.

Defined results: null role or text counts as empty; rows of a null ``conv_id``
form one conversation; null turns come first, turns with the same number follow
role, then text; repeated rows are repeated turns; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn ", "</turn>\n"
TURNS_PER_BLOCK = 256


def escape(text: Column) -> Column:
    return F.replace(
        F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g")
    )


def unescape(text: Column) -> Column:
    return F.replace(
        F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\")
    )


def format_turns(turns: DataFrame, per_block: int = TURNS_PER_BLOCK) -> DataFrame:
    """``conv_id, block, place, turn, role, piece, trainable, begin, start, end``, a row per turn.

    ``piece`` is the formatted turn, ``begin`` its place in the formatted
    conversation; ``start`` and ``end`` bound the text inside it. Offsets are
    characters. Turns are numbered inside blocks of ``per_block`` turn numbers,
    and blocks are added up per conversation, so that a conversation with a
    third of all rows is not sorted in one task.
    """
    role = F.coalesce("role", F.lit(""))
    shown = escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), escape(role), F.lit(">"))
    pieces = turns.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / per_block), F.lit(-(2**62))).alias("block"),
        "turn",
        role.alias("role"),
        F.concat(head, shown, F.lit(CLOSE)).alias("piece"),
        F.length(head).cast("bigint").alias("_head"),
        F.length(shown).cast("bigint").alias("_text"),
    ).withColumn("_long", F.col("_head") + F.col("_text") + len(CLOSE))
    sizes = pieces.groupBy("conv_id", "block").agg(F.sum("_long").alias("_long"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("conv_id").alias("_conv"),
        F.col("block").alias("_block"),
        F.coalesce(F.sum("_long").over(earlier), F.lit(0)).alias("_base"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "piece")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        pieces.withColumn("place", F.row_number().over(inside))
        .withColumn("_before", F.coalesce(F.sum("_long").over(before), F.lit(0)))
        .join(starts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
        .withColumn("begin", F.col("_base") + F.col("_before"))
        .withColumn("start", F.col("begin") + F.col("_head"))
        .select(
            "conv_id",
            "block",
            "place",
            "turn",
            "role",
            "piece",
            (F.col("role") == "assistant").alias("trainable"),
            "begin",
            "start",
            (F.col("start") + F.col("_text")).alias("end"),
        )
    )


def conversation_blocks(pieces: DataFrame) -> DataFrame:
    """``conv_id, block, begin, formatted``: the text of each block; those of a conversation in order are its text."""
    parts = F.array_sort(F.collect_list(F.struct("place", "begin", "piece")))
    return (
        pieces.groupBy("conv_id", "block")
        .agg(parts.alias("p"), F.min("begin").alias("begin"))
        .select(
            "conv_id",
            "block",
            "begin",
            F.array_join(F.transform("p", lambda x: x.piece), "").alias("formatted"),
        )
    )


def prefix_examples(pieces: DataFrame) -> DataFrame:
    """``conv_id, block, turn, start, end, text``: one example per assistant turn, whose reply lies in ``block``.

    ``text`` is the conversation from its first turn up to the reply, which ends it; the loss mask is
    ``start .. end``. A row is made from its block's when it is asked for, so texts are not shuffled.
    """
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.array_join(F.collect_list("formatted").over(earlier), "")
    so_far = conversation_blocks(pieces).select("conv_id", "block", F.concat(before, "formatted").alias("_so_far"))
    replies = (
        pieces.filter("trainable")
        .groupBy(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"))
        .agg(F.collect_list(F.struct("turn", "start", "end")).alias("_replies"))
    )
    here = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    each = so_far.join(replies, here).select("conv_id", "block", "_so_far", F.inline("_replies"))
    return each.select(
        "conv_id", "block", "turn", "start", "end", F.substring("_so_far", F.lit(1), F.col("end").cast("int")).alias("text")
    )


def masked(examples: DataFrame) -> DataFrame:
    """``conv_id, trained``: what lies under the masks of a conversation's examples, unescaped and in order."""
    length = (F.col("end") - F.col("start")).cast("int")
    reply = unescape(F.substring("text", (F.col("start") + 1).cast("int"), length))
    replies = F.array_sort(F.collect_list(F.struct("start", reply.alias("reply"))))
    joined = F.array_join(F.transform("r", lambda x: x.reply), "")
    return examples.groupBy("conv_id").agg(replies.alias("r")).select("conv_id", joined.alias("trained"))


def read_back(blocks: DataFrame) -> DataFrame:
    """``conv_id, block, turns, formatted_chars`` parsed from formatted text; ``turns`` lists ``(role, text)``, unescaped."""
    marked = F.filter(F.split("formatted", CLOSE, -1), lambda x: x != "")
    turn = F.transform(
        marked,
        lambda x: F.struct(
            unescape(F.regexp_extract(x, r"(?s)^<turn ([^>]*)>", 1)).alias("role"),
            unescape(F.regexp_extract(x, r"(?s)^<turn [^>]*>(.*)$", 1)).alias("text"),
        ),
    )
    return blocks.select(
        "conv_id", "block", turn.alias("turns"), F.length("formatted").cast("bigint").alias("formatted_chars")
    )


def chat_digest(turns: DataFrame) -> DataFrame:
    """Counts and digests of each formatted conversation, read back from the formatted text and from the examples."""
    pieces = format_turns(turns)
    parsed = read_back(conversation_blocks(pieces)).select(
        "conv_id",
        F.struct(
            "block",
            F.array_join(
                F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""
            ).alias("said"),
        ).alias("part"),
        F.size("turns").cast("bigint").alias("n"),
        "formatted_chars",
    )
    whole = parsed.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.array_sort(F.collect_list("part")).alias("parts"),
        F.sum("formatted_chars").alias("formatted_chars"),
    )
    trained = masked(prefix_examples(pieces)).withColumnRenamed("conv_id", "_conv")
    loss = F.coalesce("trained", F.lit(""))
    return whole.join(trained, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("parts", lambda p: p.said), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
