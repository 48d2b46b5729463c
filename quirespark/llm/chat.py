"""Conversations as training texts with a loss mask, and back, in DataFrame functions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of the same role become one marked turn
whose texts a joint separates; marks and texts are concatenated. Inside texts and roles every control string, the
template's own marks and those of other templates, gets a backslash after its first character and backslashes are doubled,
so a text can't forge a mark and reading back gives the very turns. The loss mask is a list of intervals of code points,
one for each text of a trained role, without marks.

Texts are escaped row by row before they meet; what meets in one task is one conversation, which is one row of the
result by definition and so has to fit a row (2 GB). Positions are running sums in two levels, so a conversation of n
turns costs n * CHUNK steps and not n squared.

Defined cases: a null text or role counts as empty; rows with equal turn numbers are ordered by role, then text; rows that
repeat are turns of their own; null turn numbers come first; rows without a conversation id form one conversation with a null
id; an empty table gives an empty result; other columns are left out, so their names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Running sums and substrings go by so many elements or characters.
CHUNK = 512
WINDOW = 4096


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a turn: opening, role, role_end, texts with joints between them, closing.

    Marks have the form <|...|>, so that none arises where a text meets a mark.
    """

    opening: str = "<|im_start|>"
    role_end: str = "<|im_sep|>"
    joint: str = "<|im_next|>"
    closing: str = "<|im_end|>"
    others: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks = self.marks
        if len({*marks}) < 4 or not all(re.fullmatch(r"<\|[^<\[|>\\]+\|>", m) for m in marks):
            raise ValueError("marks must differ and look like <|name|>")
        for c in self.others:
            if not re.fullmatch(r"[<\[](?!\|)[^|\\]*[^<\[|\\]|<\|[^<\[|>\\]+\|>", c):
                raise ValueError(f"{c!r} could arise where a text meets a mark")
        if any(a != b and b.startswith(a) for a in self.control for b in self.control):
            raise ValueError("no control string may begin another")

    @property
    def marks(self) -> tuple[str, str, str, str]:
        return self.opening, self.role_end, self.joint, self.closing

    @property
    def control(self) -> tuple[str, ...]:
        return self.marks + self.others


CHATML = ChatTemplate()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quoted(*strings: str) -> str:
    """A pattern of any of the strings."""
    return "|".join(rf"\Q{s}\E" for s in strings)


def escaped(text: Column, template: ChatTemplate = CHATML) -> Column:
    after = [rf"(?<=\Q{first}\E)(?={quoted(*rests)})" for first in "<[" if (rests := [c[1:] for c in template.control if c[0] == first])]
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), "|".join(after), "\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def running_sums(lengths: Column) -> Column:
    """array<bigint> of the sums up to each element, by chunks."""

    def sums(part: Column) -> Column:
        return F.slice(F.aggregate(part, F.array(F.lit(0).cast("long")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)), 2, F.size(part))

    def of(all_lengths: Column) -> Column:
        starts = F.when(F.size(all_lengths) > 0, F.sequence(F.lit(0), F.size(all_lengths) - 1, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
        chunks = F.transform(starts, lambda at: sums(F.slice(all_lengths, at + 1, F.lit(CHUNK))))
        return let(chunks, lambda cs: let(sums(F.transform(cs, lambda c: F.element_at(c, -1))), lambda ends: F.flatten(F.transform(cs, lambda c, i: let(F.coalesce(F.get(ends, i - 1), F.lit(0)), lambda before: F.transform(c, lambda x: x + before))))))

    return let(lengths, of)


def merged(turns: Column) -> Column:
    """array<struct<role, trained, texts>>: sorted turns, adjacent ones of the same role as one."""
    starts = lambda ts: F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (i == 0) | (F.get(ts, i)["role"] != F.get(ts, i - 1)["role"]))

    def blocks(ts: Column, at: Column) -> Column:
        def block(a: Column, k: Column) -> Column:
            own = F.slice(ts, a + 1, F.coalesce(F.get(at, k + 1), F.size(ts)) - a)
            return F.struct(F.get(ts, a)["role"].alias("role"), F.get(ts, a)["trained"].alias("trained"), F.transform(own, lambda t: t["text"]).alias("texts"))

        return F.transform(at, block)

    return let(turns, lambda ts: let(starts(ts), lambda at: blocks(ts, at)))


def _spans(blocks: Column, template: ChatTemplate) -> Column:
    """array<struct<start, length>>: code points, from 0, of the trained texts."""
    opening, role_end, joint, closing = (len(m) for m in template.marks)

    def pieces(b: Column) -> Column:
        def piece(text: Column, k: Column) -> Column:
            lead = F.when(k == 0, F.char_length(b["role"]) + opening + role_end).otherwise(joint)
            tail = F.when(k == F.size(b["texts"]) - 1, closing).otherwise(0)
            return F.struct(lead.cast("long").alias("lead"), F.char_length(text).cast("long").alias("body"), tail.cast("long").alias("tail"), b["trained"].alias("trained"))

        return F.transform(b["texts"], piece)

    def placed(ps: Column) -> Column:
        ends = running_sums(F.transform(ps, lambda p: p["lead"] + p["body"] + p["tail"]))
        at = F.zip_with(ps, ends, lambda p, end: F.struct((end - p["tail"] - p["body"]).alias("start"), p["body"].alias("length"), p["trained"].alias("trained")))
        return F.transform(F.filter(at, lambda s: s["trained"] & (s["length"] > 0)), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))

    return let(F.flatten(F.transform(blocks, pieces)), placed)


def format_chats(turns: DataFrame, template: ChatTemplate = CHATML, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id_col, formatted (string) and loss (array<struct<start, length>>, in code points of formatted) of each conversation."""
    opening, role_end, joint, closing = template.marks
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    one = F.struct(F.col(turn_col).alias("turn"), escaped(role, template).alias("role"), escaped(F.col(text_col), template).alias("text"), role.isin(*template.trained).alias("trained"))
    blocks = turns.select(F.col(id_col).alias("id"), one.alias("one")).groupBy("id").agg(F.sort_array(F.collect_list("one")).alias("turns")).select("id", merged(F.col("turns")).alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit(opening), b["role"], F.lit(role_end), F.array_join(b["texts"], joint), F.lit(closing))), "")
    return blocks.select(F.col("id").alias(id_col), text.alias("formatted"), _spans(F.col("blocks"), template).alias("loss"))


def masked_text(formatted: Column, loss: Column) -> Column:
    """The characters of formatted that lie in the intervals of loss, in order. Each interval is cut from the few windows of
    WINDOW characters that it touches, not counted from the beginning."""

    def cut(windows: Column) -> Column:
        def one(s: Column) -> Column:
            first = F.floor(s["start"] / WINDOW).cast("int")
            last = F.floor((s["start"] + s["length"] - 1) / WINDOW).cast("int")
            return F.substring(F.array_join(F.slice(windows, first + 1, last - first + 1), ""), (s["start"] % WINDOW + 1).cast("int"), s["length"].cast("int"))

        return F.array_join(F.transform(loss, one), "")

    return let(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{WINDOW}}}"), F.lit(0)), cut)


def read_chats(chats: DataFrame, template: ChatTemplate = CHATML, id_col: str = "conv_id") -> DataFrame:
    """id_col, turns (array<struct<role, text>>) and loss_text of formatted conversations, read from formatted and loss alone."""
    opening, *inner = template.marks

    def turns_of(part: Column) -> Column:  # role, role_end, text, (joint, text)*, closing
        fields = F.split(part, quoted(*inner))
        return let(fields, lambda f: let(unescaped(F.get(f, F.lit(0))), lambda role: F.transform(F.slice(f, 2, F.size(f) - 2), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))))

    parts = F.split("formatted", quoted(opening))
    turns = let(parts, lambda ps: F.flatten(F.transform(F.slice(ps, 2, F.size(ps) - 1), turns_of)))
    return chats.select(F.col(id_col), turns.alias("turns"), unescaped(masked_text(F.col("formatted"), F.col("loss"))).alias("loss_text"), "formatted")
