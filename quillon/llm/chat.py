"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted by turn; adjacent turns of one role become one block by
array aggregation; blocks are concatenated. The template is::

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT...<|im_end|>\\n

with <|im_sep|> between the merged turns of a block, so that ``read_chat`` gets every turn back. Inside roles and
texts the escape sign U+241B becomes U+241B 0, ``<|`` becomes U+241B 1 and (in roles) the line feed U+241B 2, so
no control string can come from a text. The loss mask covers the texts of LEARNED roles, without any control string.

Null text and null role: empty. Null turns sort first, equal turns by role and text; repeated rows stay. A table
without rows gives none; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
START, SEP, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
SIGN = "␛"
LEARNED = ("assistant",)


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit(SIGN), F.lit(SIGN + "0")), F.lit("<|"), F.lit(SIGN + "1"))
    return F.replace(c, F.lit("\n"), F.lit(SIGN + "2")) if role else c


def unescape(c: Column) -> Column:
    for code, text in (("2", "\n"), ("1", "<|"), ("0", SIGN)):
        c = F.replace(c, F.lit(SIGN + code), F.lit(text))
    return c


def format_chat(turns: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """conv_id, formatted and segments (array of text, in_loss: the pieces of formatted in order) per conversation of
    turns (conv_id, turn, role, text)."""
    struct = F.struct(
        "turn", escape(F.coalesce(F.col("role").cast("string"), F.lit("")), True).alias("role"), escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text")
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(struct)).alias("turns"))
    ordinals = F.sequence(F.lit(0), F.size("turns") - 1)
    begins = F.filter(ordinals, lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    cut = sorted_turns.select("conv_id", "turns", begins.alias("begins"))
    blocks = F.transform(
        "begins",
        lambda at, k: F.struct(
            F.get("turns", at)["role"].alias("role"),
            F.slice("turns", at + 1, F.coalesce(F.get("begins", k + 1), F.size("turns")) - at).alias("own"),
        ),
    )
    merged = cut.select("conv_id", blocks.alias("blocks"))
    in_loss = lambda role: role.isin(*learned)
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("in_loss"))
    of_block = lambda b: F.concat(
        F.flatten(
            F.transform(
                b["own"],
                lambda t, i: F.array(
                    piece(F.when(i == 0, F.concat(F.lit(START), b["role"], F.lit("\n"))).otherwise(F.lit(SEP)), F.lit(False)), piece(t["text"], in_loss(b["role"]))
                ),
            )
        ),
        F.array(piece(F.lit(STOP), F.lit(False))),
    )
    cut_up = merged.select("conv_id", F.flatten(F.transform("blocks", of_block)).alias("segments"))
    return cut_up.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def read_chat(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    blocks = F.filter(F.split(formatted, literal(START)), lambda _, i: i > 0)
    of_block = lambda b: F.transform(
        F.split(F.substring(b, F.position(F.lit("\n"), b) + 1, F.length(b) - F.position(F.lit("\n"), b) - len(STOP)), literal(SEP)),
        lambda t: F.struct(unescape(F.substring_index(b, "\n", 1)).alias("role"), unescape(t).alias("text")),
    )
    return F.flatten(F.transform(blocks, of_block))


def chat_digest(turns: DataFrame) -> DataFrame:
    """What read_chat and the loss mask give back for each conversation."""
    read = format_chat(turns).select("conv_id", "formatted", read_chat(F.col("formatted")).alias("turns"), "segments")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["in_loss"]), lambda s: unescape(s["text"])), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("loss"))
    return read.select(
        "conv_id", "n_turns", F.sha2(F.encode("said", "UTF-8"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
