"""Chat formatting: a finite-state machine over roles and a declarative template, all in DataFrame functions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings, roles under the loss mask, and the turn-order machine.

    Every control string begins with `opener`. Inside texts and roles `escape` is doubled and put
    into every opener, so no control string can occur there and the change can be undone.
    """

    start: str = "<|im_start|>"
    separator: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    opener: str = "<|"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    first_state: str = "begin"
    final_states: tuple[str, ...] = ("assistant",)
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("begin", "system"): "system",
            ("begin", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )

    def __post_init__(self):
        if not all(c.startswith(self.opener) for c in (self.start, self.separator, self.end)):
            raise ValueError("every control string must begin with the opener")


def escaped(text: Column, t: Template) -> Column:
    doubled = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    return F.replace(doubled, F.lit(t.opener), F.lit(t.opener[0] + t.escape + t.opener[1:]))


def unescaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, f"(?s){re.escape(t.escape)}(.)", "$1")


def _final_state(turns: Column, t: Template) -> Column:
    edges = F.create_map(*[F.lit(x) for (a, role), b in t.transitions.items() for x in (f"{a}\n{role}", b)])
    return F.aggregate(
        turns,
        F.lit(t.first_state),
        lambda state, turn: F.coalesce(F.get(F.array(F.try_element_at(edges, F.concat(state, F.lit("\n"), turn["role"]))), F.lit(0)), F.lit("reject")),
    )


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conv_id: conv_id, formatted, segments (array of text and loss), n_turns, final_state, valid.

    Turns are ordered by turn, then role and text, so ties and repeated rows have one order. A null role
    or text counts as empty, a null turn sorts first, a null conv_id is a conversation of its own; extra
    columns are ignored and an empty table gives no rows. A turn order the machine rejects only makes
    `valid` false: the conversation is still formatted whole. One conversation is one output value, so
    its turns meet in one row.
    """
    t = template
    rows = conversations.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("turn"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                segment(F.concat(F.lit(t.start), escaped(x["role"], t), F.lit(t.separator)), no),
                segment(escaped(x["text"], t), x["role"].isin(*t.loss_roles)),
                segment(F.lit(t.end), no),
            ),
        )
    )
    state = _final_state(F.col("turns"), t)
    return grouped.select(
        "conv_id",
        segments.alias("segments"),
        F.size("turns").cast("long").alias("n_turns"),
        state.alias("final_state"),
    ).select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        "n_turns",
        "final_state",
        F.col("final_state").isin(*t.final_states).alias("valid"),
    )


def parse_formatted(formatted: Column, template: Template = Template()) -> Column:
    """Turns (array of role, text) read back from a formatted conversation, escapes undone."""
    t = template
    pieces = F.filter(F.split(formatted, re.escape(t.end)), lambda p: p != F.lit(""))
    body = lambda p: F.substring(p, F.lit(len(t.start) + 1), F.length(p))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring_index(body(p), t.separator, 1), t).alias("role"),
            unescaped(F.substring(body(p), F.length(F.substring_index(body(p), t.separator, 1)) + len(t.separator) + 1, F.length(p)), t).alias("text"),
        ),
    )


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, escapes undone, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
