"""Chat formatting: a finite-state machine over roles and a declarative template.

Everything is DataFrame functions. A conversation's turns are put in order, a fold over
their roles walks the machine, and the template turns each turn into three segments
(opening, text, closing) with a loss flag each. The formatted text is all segments
joined. Control strings inside texts and roles are escaped: between ``<`` and ``|`` one
backslash is added, so no text can hold a control string, and taking one away gives
the text back.

A conversation is one training sample, hence one row; it is the only unit that is
gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REJECTED = "rejected"


@dataclass(frozen=True)
class Template:
    """Turn markers, the roles trained on, and the machine: (state, role) to state."""

    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>"
    trained: tuple[str, ...] = ("assistant",)
    first_state: str = "empty"
    accepting: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("empty", "system"): "instructed",
        ("empty", "user"): "asked",
        ("instructed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    })

    def __post_init__(self):
        for mark in (self.opening, self.closing):
            if not mark.startswith("<|") or "\\" in mark or mark.count("<") > 1:
                raise ValueError("a control string starts with <| and holds no backslash and no other <")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role_written(role: Column) -> Column:
    """A role on one line: backslash and line end are written as two letters."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _role_read(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def _walk(turns: Column, template: Template) -> Column:
    """(state, done, refused): the machine's last state, the turns taken, and the
    place of the turn it refused."""
    pairs = [x for (state, role), to in template.moves.items() for x in (F.lit(f"{state}\n{role}"), F.lit(to))]
    moves = F.create_map(*pairs)
    start = F.struct(
        F.lit(template.first_state).alias("state"), F.lit(0).alias("done"), F.lit(None).cast("int").alias("refused")
    )

    def step(at: Column, turn: Column) -> Column:
        to = F.coalesce(F.element_at(moves, F.concat_ws("\n", at["state"], turn["role"])), F.lit(REJECTED))
        return F.struct(
            to.alias("state"), (at["done"] + 1).alias("done"),
            F.coalesce(at["refused"], F.when(to == REJECTED, at["done"])).alias("refused"),
        )

    return F.aggregate(turns, start, step)


def formatted(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text):

    n_turns; valid (the machine ends in an accepting state); refused_turn (place from 0
    of the first turn without a move, null if none); segments (text, loss), escaped;
    formatted, all segments joined.

    Every conversation is formatted, valid or not. Turns go by ``turn``, ties by role and
    text; rows without a turn come first. Null roles and texts are empty; rows with a
    null conv_id are one conversation; repeated rows are turns of their own. Other
    columns are ignored; an empty table gives an empty result.
    """
    row = F.struct(
        F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))

    def segments(turn: Column) -> Column:
        plain = F.lit(False).alias("loss")
        opening = F.concat(F.lit(template.opening), _role_written(turn["role"]), F.lit("\n"))
        return F.array(
            F.struct(opening.alias("text"), plain),
            F.struct(escaped(turn["text"]).alias("text"), turn["role"].isin(*template.trained).alias("loss")),
            F.struct(F.lit(template.closing + "\n").alias("text"), plain),
        )

    walked = gathered.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), _walk(F.col("turns"), template).alias("walk"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    )
    return walked.select(
        "conv_id", "n_turns", F.col("walk.state").isin(*template.accepting).alias("valid"),
        F.col("walk.refused").alias("refused_turn"), "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def turns_read(text: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted text, unescaped."""
    rest = len(template.closing) + 1

    def read(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        start = F.length(role) + 2
        return F.struct(
            _role_read(role).alias("role"),
            unescaped(F.substring(part, start, F.length(part) - start + 1 - rest)).alias("text"),
        )

    parts = F.split(text, "\\Q" + template.opening + "\\E")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), read)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
