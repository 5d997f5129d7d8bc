"""Chat formatting by a finite-state machine over roles and a declarative template.

A template names the marks around each role's text, the order roles may take, and
which texts the loss is on. Control strings inside a text are broken by an escape that
is taken back exactly, so marks are found again and a text cannot end its own turn.
Everything is DataFrame expressions; rows of a conversation are sorted once, in one
shuffle. A conversation is one training text, so its turns meet in one row.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.texts import column


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks per role; ``other`` holds (open, between role and text, close) for a role that has none.

    ``order`` maps a state, ``start`` or the last role, to the roles that may follow;
    ``final`` are the roles a conversation may end with.
    """

    roles: Mapping[str, Role]
    other: tuple[str, str, str]
    order: Mapping[str, tuple[str, ...]]
    final: tuple[str, ...]
    escape: str = "␛"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = [m for r in self.roles.values() for m in (r.open, r.close)] + list(self.other)
        if len(set(marks)) < len(marks) or any(self.escape in m or not m for m in marks):
            raise ValueError("marks must differ, and none may be empty or hold the escape")
        if any(a != b and a in b for a in marks for b in marks):
            raise ValueError("no mark may be part of another")
        object.__setattr__(self, "controls", tuple(marks))


INSTRUCT = Template(
    roles={
        "system": Role("<<SYS>>", "<</SYS>>"),
        "user": Role("[INST]", "[/INST]"),
        "assistant": Role("<s>", "</s>", loss=True),
    },
    other=("[AS]", "[SAYS]", "[/AS]"),
    order={
        "start": ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    },
    final=("assistant",),
)


def escape(text: Column, template: Template = INSTRUCT) -> Column:
    """The text with the escape put behind the first character of every control string."""
    sign = template.escape
    pattern = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in template.controls)
    return F.regexp_replace(F.replace(text, F.lit(sign), F.lit(sign + "0")), pattern, sign + "1")


def unescape(text: Column, template: Template = INSTRUCT) -> Column:
    sign = template.escape
    return F.replace(F.replace(text, F.lit(sign + "1"), F.lit("")), F.lit(sign + "0"), F.lit(sign))


def _states(roles: Column, template: Template) -> Column:
    """The state after each turn: the role while the order holds, null from the first turn that breaks it."""
    allowed = F.array(*[F.lit(f"{s}>{r}") for s, following in template.order.items() for r in following])
    start = F.array(F.lit("start"))

    def step(states: Column, role: Column) -> Column:
        last = F.element_at(states, -1)
        ok = F.coalesce(F.array_contains(allowed, F.concat(last, F.lit(">"), role)), F.lit(False))
        return F.concat(states, F.array(F.when(ok, role)))

    return F.aggregate(roles, start.cast("array<string>"), step)


def _segments(turn: Column, template: Template) -> Column:
    """(text, loss) pieces of one turn."""

    def piece(text: Column, loss: bool) -> Column:
        return F.struct(text.alias("text"), F.lit(loss).alias("loss"))

    said = escape(turn["text"], template)
    before, between, after = map(F.lit, template.other)
    head = F.concat(before, escape(turn["role"], template), between)
    found = F.array(piece(head, False), piece(said, False), piece(after, False))
    for name, role in template.roles.items():
        pieces = F.array(piece(F.lit(role.open), False), piece(said, role.loss), piece(F.lit(role.close), False))
        found = F.when(turn["role"] == name, pieces).otherwise(found)
    return found


def format_turns(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    template: Template = INSTRUCT,
) -> DataFrame:
    """(conversation, segments, formatted, spans, valid, first_error) of every conversation.

    ``segments`` are the pieces (text, loss) in order, ``formatted`` is all of them in
    one, ``spans`` the places (start from 0, length) in code points under the loss.
    ``valid`` tells whether the roles keep the template's order and end as they may;
    ``first_error`` is the place of the first turn that does not (the number of turns if
    only the end is wrong), else null. A conversation out of order is formatted all the
    same. Turns are in order of ``turn`` (null first), ties by role, then text; a repeated
    row is a turn of its own. A null role or text is empty, a null conversation is one
    conversation, and other columns are left out.
    """
    said = F.struct(
        column(turn).alias("turn"),
        F.coalesce(column(role), F.lit("")).alias("role"),
        F.coalesce(column(text), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy(column(conversation).alias(conversation)).agg(F.sort_array(F.collect_list(said)).alias("_turns"))
    shaped = grouped.select(
        column(conversation),
        F.flatten(F.transform("_turns", lambda t: _segments(t, template))).alias("segments"),
        F.slice(_states(F.col("_turns.role"), template), 2, F.greatest(F.size("_turns"), F.lit(1))).alias("_states"),
    )
    walked = F.aggregate(
        "segments",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans")),
        lambda a, s: F.struct(
            (a["at"] + F.length(s["text"])).alias("at"),
            F.when(
                s["loss"],
                F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.length(s["text"]).cast("bigint").alias("length")))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
    )
    broken = F.array_position(F.transform("_states", lambda s: s.isNull()), True) - 1
    ends = F.coalesce(F.element_at("_states", -1).isin(*template.final), F.lit(False))
    return shaped.select(
        column(conversation),
        "segments",
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        walked["spans"].alias("spans"),
        (ends & (broken < 0)).alias("valid"),
        F.when(broken >= 0, broken).when(~ends, F.size("_states").cast("bigint")).alias("first_error"),
    )


def read_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns (role, text) that a formatted text holds."""
    known = "|".join(re.escape(r.open) for r in template.roles.values())
    before, between, after = map(re.escape, template.other)
    closes = "|".join([*[re.escape(r.close) for r in template.roles.values()], after])
    pattern = f"(?s)((?:{known})|{before}.*?{between})(.*?)(?:{closes})"
    heads = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(2))

    def turn(head: Column, text: Column) -> Column:
        name = F.regexp_extract(head, f"(?s)^{before}(.*){between}$", 1)
        role = unescape(name, template)
        for known_name, marks in template.roles.items():
            role = F.when(head == marks.open, known_name).otherwise(role)
        return F.struct(role.alias("role"), unescape(text, template).alias("text"))

    return F.zip_with(heads, texts, turn)


def read_loss(formatted: Column, spans: Column, template: Template = INSTRUCT) -> Column:
    """All the text under the loss, as it was before formatting."""
    parts = F.transform(
        spans, lambda s: F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
    )
    return unescape(F.array_join(parts, ""), template)
