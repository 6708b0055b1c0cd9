"""Chat formatting with Spark expressions only: turns to one marked text and its loss mask, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, NEXT, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    r"""No ``<|`` is left: a backslash is doubled, then ``<|`` becomes ``<\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    r"""Inverse of ``escape``: only an escaped ``<|`` has a single backslash between ``<`` and ``|``."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    r"""As ``escape``; a line end, which closes the role, becomes ``<\n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def format_chats(df: DataFrame) -> DataFrame:
    r"""conv_id, formatted, loss_mask from rows (conv_id, turn, role, text).

    A run of turns with one role is one block: ``<|im_start|>role\ntext<|im_sep|>text<|im_end|>\n``. ``loss_mask`` has
    for each turn the characters of marks before its text, of its (escaped) text, and whether the text is learned; what
    is left at the end is marks. Turns are ordered by (turn, role, text), nulls first, so ties have one order; repeated
    rows stay. A null role or text is an empty one, a null conv_id a conversation of its own; an empty table gives no
    rows; further columns are not read. A conversation is one row of the result by definition and is gathered as one.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sorted_turns = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(this: Column, i: Column) -> Column:
        same = (i > 0) & (F.get("turns", i - 1)["role"] == this["role"])
        opened = F.concat(F.lit(OPEN), escape_role(this["role"]), F.lit("\n"))
        marks = F.when(same, F.lit(NEXT)).when(i > 0, F.concat(F.lit(CLOSE), opened)).otherwise(opened)
        return F.struct(
            marks.alias("marks"), escape(this["text"]).alias("text"), (this["role"] == LEARNED).alias("learned")
        )

    pieces = sorted_turns.select("conv_id", F.transform("turns", piece).alias("pieces"))
    return pieces.select(
        "conv_id",
        F.concat(
            F.array_join(F.transform("pieces", lambda p: F.concat(p["marks"], p["text"])), ""), F.lit(CLOSE)
        ).alias("formatted"),
        F.transform(
            "pieces",
            lambda p: F.struct(
                F.length(p["marks"]).alias("marks"), F.length(p["text"]).alias("chars"), p["learned"].alias("learned")
            ),
        ).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text, escaped)."""

    def block(marked: Column) -> Column:
        role = F.substring_index(marked, "\n", 1)
        body = F.substr(marked, F.length(role) + 2)
        return F.transform(
            F.split(body, f"\\Q{NEXT}\\E", -1),
            lambda t: F.struct(
                unescape_role(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"),
                unescape(t).alias("text"),
                t.alias("escaped"),
            ),
        )

    blocks = F.split(formatted, f"\\Q{CLOSE}\\E", -1)  # the last part is empty
    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), block))


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of turns and learned text, read back from ``formatted`` and ``loss_mask``."""
    read = chats.select("conv_id", "loss_mask", F.length("formatted").alias("formatted_chars"), read_turns(F.col("formatted")).alias("read"))
    learned = F.zip_with(
        "read", "loss_mask",
        lambda turn, mask: F.when(
            mask["learned"], unescape(F.substr(turn["escaped"], F.lit(1), mask["chars"]))
        ).otherwise(F.lit("")),
    )
    whole = F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("read").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(whole, ""), 256).alias("turns_sha256"),
        F.array_join(learned, "").alias("learned"),
        F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    ).select(
        "conv_id", "n_turns", "turns_sha256",
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )
