"""Chat formatting by a finite-state machine over roles, in DataFrame functions only.

A template names, for each role, the mark before and after a turn, whether the turn's text is learned, and which roles
may follow. The output of a conversation is a list of segments ``(text, loss)``; their texts joined are the formatted
conversation. Marks inside texts are escaped reversibly: a backslash becomes ``\\e`` and the first character of every
mark becomes ``\\l`` (``<``) or ``\\b`` (``[``), so that each backslash of formatted text starts exactly one escape.
``read_back`` parses formatted text again.

Turn order is validated by folding the roles through the machine; conversations that break it are formatted all the
same and say so in ``valid``.

Defined cases: null texts and null roles are empty strings; turns are ordered by turn (nulls first), then role, then
text, so that ties are stable; repeated rows are turns of their own; a null conversation id is a conversation; empty
tables give empty results; input columns other than the four named ones are not carried along.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``roles`` have marks of their own; any other role is named between ``named``'s marks. ``follow``: state → roles."""

    roles: dict[str, Turn]
    named: tuple[str, str, str]
    follow: dict[str, tuple[str, ...]]
    start: str = "start"
    ends: tuple[str, ...] = ()
    marks: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = {m for t in self.roles.values() for m in (t.before, t.after)} | set(self.named)
        if any(m[0] not in "<[" or "\\" in m for m in marks):
            raise ValueError("marks begin with < or [ and hold no backslash")
        object.__setattr__(self, "marks", tuple(sorted(marks)))


#: Instruction marks; the assistant's texts are learned.
INSTRUCT = Template(
    roles={"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("<s>", "</s>", loss=True)},
    named=("[ROLE]", "[/ROLE]", "[END]"),
    follow={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("user", "assistant"),
)


def _ahead(template: Template, first: str) -> str:
    rests = [re.sub(r"([\[\]/<>|])", r"\\\1", m[1:]) for m in template.marks if m[0] == first]
    return re.sub(r"([\[<])", r"\\\1", first).replace("\\<", "<") + "(?=" + "|".join(rests) + ")"


def escaped(text: Column, template: Template = INSTRUCT) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for first, letter in (("<", "l"), ("[", "b")):
        if any(m[0] == first for m in template.marks):
            out = F.regexp_replace(out, _ahead(template, first), "\\\\" + letter)
    return out


def unescaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\l"), F.lit("<"))
    out = F.replace(out, F.lit("\\b"), F.lit("["))
    return F.replace(out, F.lit("\\e"), F.lit("\\"))


def _choose(role: Column, template: Template, of, otherwise: Column) -> Column:
    out = None
    for name, turn in template.roles.items():
        value = of(turn)
        out = F.when(role == name, value) if out is None else out.when(role == name, value)
    return out.otherwise(otherwise)


def format_chats(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = INSTRUCT
) -> DataFrame:
    """``conv_col, n_turns, segments, formatted, valid`` of each conversation."""
    role = F.coalesce(F.col(role_col), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    opening, closing, end = template.named
    turns = df.select(
        F.col(conv_col),
        F.struct(
            F.col(turn_col).alias("turn"),
            role.alias("role"),
            text.alias("text"),
            _choose(role, template, lambda t: F.lit(t.before), F.concat(F.lit(opening), escaped(role, template), F.lit(closing))).alias("before"),
            escaped(text, template).alias("body"),
            _choose(role, template, lambda t: F.lit(t.after), F.lit(end)).alias("after"),
            _choose(role, template, lambda t: F.lit(t.loss), F.lit(False)).alias("loss"),
        ).alias("one"),
    )
    chats = turns.groupBy(conv_col).agg(F.sort_array(F.collect_list("one")).alias("turns"))
    allowed = [f"{state}>{role}" for state, roles in template.follow.items() for role in roles]
    state = F.aggregate(
        F.transform("turns", lambda t: t["role"]),
        F.lit(template.start),
        lambda s, r: F.when(F.concat(s, F.lit(">"), r).isin(allowed), r).otherwise(F.lit("!")),
    )
    segment = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns", lambda t: F.array(segment(t["before"], F.lit(False)), segment(t["body"], t["loss"]), segment(t["after"], F.lit(False)))
        )
    )
    chats = chats.select(conv_col, F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"), state.isin(*template.ends).alias("valid"))
    return chats.select(conv_col, "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns of formatted text: an array of ``(role, text)``, unescaped."""
    quoted = lambda m: re.sub(r"([\[\]/|])", r"\\\1", m)
    opening, closing, end = map(quoted, template.named)
    before = "|".join(quoted(t.before) for t in template.roles.values())
    after = "|".join([*(quoted(t.after) for t in template.roles.values()), end])
    pattern = F.lit(f"(?s)(?:({before})|{opening}(.*?){closing})(.*?)(?:{after})")
    part = lambda i: F.regexp_extract_all(formatted, pattern, F.lit(i))
    mark_to_role = lambda mark, name: _by_mark(mark, template, unescaped(name))
    return F.transform(
        F.arrays_zip(part(1).alias("mark"), part(2).alias("name"), part(3).alias("body")),
        lambda x: F.struct(mark_to_role(x["mark"], x["name"]).alias("role"), unescaped(x["body"]).alias("text")),
    )


def _by_mark(mark: Column, template: Template, otherwise: Column) -> Column:
    out = None
    for name, turn in template.roles.items():
        out = F.when(mark == turn.before, F.lit(name)) if out is None else out.when(mark == turn.before, F.lit(name))
    return out.otherwise(otherwise)


def learned(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescaped(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
