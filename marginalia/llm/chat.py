"""Chat formatting in DataFrame operations alone: a finite-state machine over roles, and a declarative template.

The template turns each turn into three segments, its opening mark, its text and its closing mark, and says for each
whether the loss counts it. Marks are control strings; where a text has one, an escape is put after its first character,
so a text can never pass for a mark, and the formatted conversation can be read back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The escape character; it is itself written as ESCAPE + "e", the mark inside a control string as ESCAPE + "x".
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """turn opens every turn, whatever its role; roles have marks of their own, other roles are named between the first two
    of `other`. learn: the roles whose text counts for the loss. after: which roles may follow which; "" is the start."""

    turn: str = "<s>"
    roles: dict = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "</s>")})
    other: tuple = ("[ROLE ", "] ", " [/ROLE]")
    learn: tuple = ("assistant",)
    after: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def controls(self) -> list[str]:
        marks = [self.turn, *(m for pair in self.roles.values() for m in pair), self.other[0], self.other[2]]
        return sorted({m.strip() for m in marks}, key=lambda m: (-len(m), m))


def escape(text: Column, template: Template) -> Column:
    """The text without any control string in it, reversibly."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e"))
    for m in template.controls():
        out = F.replace(out, F.lit(m), F.lit(m[0] + ESCAPE + "x" + m[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "x"), F.lit("")), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def _role_name(role: Column, template: Template) -> Column:
    return F.replace(escape(role, template), F.lit("]"), F.lit(ESCAPE + "c"))


def _segments(turn: Column, template: Template) -> Column:
    role = turn["role"]
    opening = F.concat(F.lit(template.turn + template.other[0]), _role_name(role, template), F.lit(template.other[1]))
    closing = F.lit(template.other[2])
    for name, (a, b) in template.roles.items():
        opening = F.when(role == name, F.lit(template.turn + a)).otherwise(opening)
        closing = F.when(role == name, F.lit(b)).otherwise(closing)
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.array(part(opening, F.lit(False)), part(escape(turn["text"], template), role.isin(list(template.learn))), part(closing, F.lit(False)))


def _parse(piece: Column, template: Template) -> Column:
    """The role and the text of one turn, from its formatted form without the turn mark."""
    first, middle, last = template.other
    pattern = f"(?s)^{re.escape(first)}(.*?){re.escape(middle)}(.*){re.escape(last)}$"
    named = F.replace(F.regexp_extract(piece, pattern, 1), F.lit(ESCAPE + "c"), F.lit("]"))
    role, text = unescape(named), F.regexp_extract(piece, pattern, 2)
    for name, (a, b) in template.roles.items():
        inner = F.substring(piece, F.lit(len(a) + 1), F.char_length(piece) - len(a) - len(b))
        role = F.when(piece.startswith(a), F.lit(name)).otherwise(role)
        text = F.when(piece.startswith(a), inner).otherwise(text)
    return F.struct(role.alias("role"), unescape(text).alias("text"))


def render(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, valid, segments (an array of text and loss) and formatted, for every conversation.

    turns has conv_id, turn, role and text. Turns of one conversation are ordered by turn, then role, then text, nulls
    first; a null role or text is empty; repeated rows are as many turns; a row of null conv_id is a conversation by itself, as
    nothing says where it belongs, so nulls gather nowhere. valid: the machine accepted the order of roles; an order it doesn't accept is formatted all the same. Other columns play no
    part; an empty table gives an empty one. One shuffle by conversation: a conversation is one row of the result, so it
    has to fit into a task, and no more than that is ever gathered.
    """
    template = template or Template()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    each = turns.select("conv_id", alone, F.struct("turn", text("role").alias("role"), text("text").alias("text")).alias("turn"))
    convs = each.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def follow(state: Column, turn: Column) -> Column:
        ok = F.lit(False)
        for before, roles in template.after.items():
            ok = ok | ((state == before) & turn["role"].isin(list(roles)))
        return F.when(ok, turn["role"]).otherwise(F.lit("!"))

    segments = F.flatten(F.transform("turns", lambda t: _segments(t, template)))
    out = convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), (F.aggregate("turns", F.lit(""), follow) != "!").alias("valid"), segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role and text) that a formatted conversation holds."""
    template = template or Template()
    pieces = F.split(formatted, re.escape(template.turn))
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: _parse(p, template))


def learned_text(segments: Column) -> Column:
    """All text that the loss counts, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(rendered: DataFrame, template: Template | None = None) -> DataFrame:
    """What render() made, read back: the turns from the formatted text, the learned text from the segments."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = rendered.select("conv_id", "valid", "formatted", read_back(F.col("formatted"), template).alias("back"), learned_text(F.col("segments")).alias("learned"))
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        sha(turns).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        sha(F.col("learned")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
