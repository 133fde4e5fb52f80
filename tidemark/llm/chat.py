"""Chat formatting: conversations as marked-up texts with loss masks, in Spark expressions alone.

A conversation's turns are collected, sorted, and merged where neighbours have one role. Each block is its role's opening
mark, the texts with a mark between them, and its closing mark. A text that holds a mark has a backslash put after the
mark's first character; a mark that has backslashes there already gets one more, so that taking one away gives the text
back, whatever it holds. The loss mask lists the code points that a model is trained on: the texts of one role.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}, {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
#: Blocks of any other role, which is named before the mark.
OTHER_OPEN, NAMED, OTHER_CLOSE = "[ROLE]", "[IS]", "[/ROLE]"
#: Between the texts of one block.
AND = "[AND]"
MARKS = [*OPEN.values(), *CLOSE.values(), OTHER_OPEN, NAMED, OTHER_CLOSE, AND]
#: What stands between a mark and a text, and is no part of either.
PAD = " "


def _after(first: str) -> str:
    return "|".join(re.escape(m[1:]) for m in MARKS if m[0] == first)


#: A mark with any number of backslashes after its first character.
_HELD = rf"(?:(<)(\\*(?:{_after('<')}))|(\[)(\\*(?:{_after('[')})))"
_ESCAPED = rf"(?:(<)\\(\\*(?:{_after('<')}))|(\[)\\(\\*(?:{_after('[')})))"
_BLOCK = "(?s)({}){}(.*?){}(?:{})".format("|".join(map(re.escape, [*OPEN.values(), OTHER_OPEN])), PAD, PAD, "|".join(map(re.escape, [*CLOSE.values(), OTHER_CLOSE])))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _HELD, r"$1$3\\$2$4")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$3$2$4")


def _of_role(marks: dict[str, str], role: Column, other: Column | str) -> Column:
    out = F.lit(other) if isinstance(other, str) else other
    for name, mark in marks.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def collected(turns: DataFrame, *, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key, turns``: the sorted turns (place, role, text) of each conversation."""
    rows = turns.select(F.col(key).alias("k"), F.struct(F.col(order).alias("place"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("turn"))
    return rows.groupBy("k").agg(F.sort_array(F.collect_list("turn")).alias("turns")).withColumnRenamed("k", key)


def blocks(turns: Column) -> Column:
    """Sorted turns as blocks (role, texts) of neighbours with one role."""
    n = F.size(turns)
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(begins, 2, F.size(begins)), F.array(n))
    return F.zip_with(begins, ends, lambda a, z: F.struct(F.get(turns, a)["role"].alias("role"), F.transform(F.slice(turns, a + 1, z - a), lambda t: t["text"]).alias("texts")))


def _pieces(block: Column, trained: str) -> Column:
    """A block as pieces (text, whether it is trained on)."""
    role = block["role"]
    known = role.isin(list(OPEN))
    head = F.concat(_of_role(OPEN, role, OTHER_OPEN), F.lit(PAD), F.when(known, F.lit("")).otherwise(F.concat(escaped(role), F.lit(NAMED))))
    tail = F.concat(F.lit(PAD), _of_role(CLOSE, role, OTHER_CLOSE))
    piece = lambda text, train: F.struct(text.alias("text"), train.alias("train"))
    no = F.lit(False)
    texts = F.transform(block["texts"], lambda x, i: F.array(piece(F.when(i == 0, head).otherwise(F.lit(AND)), no), piece(escaped(x), role == trained)))
    return F.concat(F.flatten(texts), F.array(piece(tail, no)))


def _spans(pieces: Column) -> Column:
    """Start (from 0) and length, in code points, of each piece that is trained on and not empty."""
    at = F.aggregate(
        pieces,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["text"])).alias("at"),
            F.when(p["train"] & (F.length(p["text"]) > 0), F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.length(p["text"]).cast("long").alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return at["spans"]


def format_turns(turns: DataFrame, *, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """``key, formatted, loss_mask``: a row for each conversation; the mask is an array of (start, length) in code points.

    Turns go by ``order`` (null first), equal places by role and text; repeated rows are repeated turns. A null role is
    the empty role, a null text the empty text, and rows with a null key are one conversation. Roles other than system,
    user and assistant are named in their mark. A conversation is one value of the output, so it must fit into a row.
    Empty tables give none; other columns are ignored.
    """
    made = collected(turns, key=key, order=order, role=role, text=text)
    made = made.select(key, F.flatten(F.transform(blocks(F.col("turns")), lambda b: _pieces(b, trained))).alias("pieces"))
    return made.select(key, F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), _spans(F.col("pieces")).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text was made of, in order."""
    opened = F.regexp_extract_all(formatted, F.lit(_BLOCK), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(_BLOCK), F.lit(2))

    def turns(mark: Column, body: Column) -> Column:
        other = mark == OTHER_OPEN
        role = F.when(other, unescaped(F.substring_index(body, NAMED, 1))).otherwise(_of_role({v: k for k, v in OPEN.items()}, mark, ""))
        rest = F.when(other, F.substring(body, F.instr(body, NAMED) + len(NAMED), F.length(body))).otherwise(body)
        return F.transform(F.split(rest, re.escape(AND), -1), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.zip_with(opened, bodies, turns))


def read_loss(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the mask, end to end."""
    cut = lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(loss_mask, cut), "")


def digests(formatted: DataFrame) -> DataFrame:
    """``format_turns``'s rows with what is read back from them: number and digest of the turns, and of the text under
    the mask."""
    made = formatted.withColumns({"_turns": read_turns(F.col("formatted")), "_loss": read_loss(F.col("formatted"), F.col("loss_mask"))})
    lines = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    made = made.withColumns(
        {
            "n_turns": F.size("_turns").cast("long"),
            "turns_sha256": F.sha2(lines.cast("binary"), 256),
            "loss_chars": F.length("_loss").cast("long"),
            "loss_sha256": F.sha2(F.col("_loss").cast("binary"), 256),
            "formatted_chars": F.length("formatted").cast("long"),
        }
    )
    return made.drop("_turns", "_loss")
