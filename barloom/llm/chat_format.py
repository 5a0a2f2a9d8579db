"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Doubles backslashes, then puts one between "<" and "|", so no control string is left in a text.

    After the doubling, runs of backslashes are even; a single one after "<" can only be the one put in.
    """
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def format_conversations(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_roles: Sequence[str] = ("assistant",),
) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments.

    The turns of a conversation are collected as structs and sorted by turn;
    neighbours of the same role are merged into one block, whose texts are set
    apart by a separator mark, so that the turns can be read back. segments is
    an array of (text, loss): their texts joined are formatted, and loss is true
    for the (escaped) texts of loss_roles, never for marks.

    Null texts and roles count as empty. Ties in turn go by role, then text; null
    turns come first. Repeated rows stay repeated turns. A null conv_id is a
    conversation like any other. Extra columns are ignored; an empty table gives
    no rows.
    """
    turns = df.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    n = F.size("t")
    starts = sorted_.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.col("t")[i]["role"] != F.get(F.col("t"), F.greatest(i - 1, F.lit(0)))["role"]),
        ),
    )
    blocks = starts.withColumn(
        "blocks",
        F.transform(
            "starts",
            lambda s, i: F.struct(
                F.col("t")[s]["role"].alias("role"),
                F.transform(
                    F.slice("t", s + 1, F.coalesce(F.get(F.col("starts"), i + 1), n) - s), lambda x: x["text"]
                ).alias("texts"),
            ),
        ),
    )

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    segments = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(segment(F.concat(F.lit(START), _escape_role(b["role"]), F.lit("\n")), no)),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda x, i: F.array(
                            segment(F.when(i == 0, F.lit("")).otherwise(F.lit(SEP)), no),
                            segment(escape(x), b["role"].isin(list(loss_roles))),
                        ),
                    )
                ),
                F.array(segment(F.lit(END + "\n"), no)),
            ),
        )
    )
    return blocks.select("conv_id", segments.alias("segments")).select(
        "conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments"
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(
                    # what stands between the role's line and the end mark with its line break
                    F.substr(b, F.instr(b, "\n") + 1, F.length(b) - F.instr(b, "\n") - F.lit(len(END) + 1)),
                    r"<\|im_sep\|>",
                ),
                lambda x: F.struct(
                    _unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(x).alias("text")
                ),
            ),
        )
    )


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Of format_conversations' rows: counts and digests of the turns and of the text under the loss mask, read back."""
    loss = F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""
    )
    turns = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return (
        formatted.select("conv_id", "formatted", "segments", read_back(F.col("formatted")).alias("turns"))
        .select("conv_id", "turns", "formatted", loss.alias("loss"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(turns, 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
