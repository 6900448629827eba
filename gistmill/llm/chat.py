"""Chat formatting: a finite-state machine over roles, and a template.

A template says which role may follow in which state, how a turn is wrapped,
and which roles are learned from. The machine is run over blocks of turns: each
block becomes a table from the state before it to the state after it, and
tables compose, so only their composition follows a conversation's order.
Everything is column expressions.

Control strings begin with ``<|``. Inside texts one backslash is put between
the two (``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|`` and so on), which
leaves no control string in a text and can be undone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128


@dataclass(frozen=True)
class Template:
    """Marks around a turn, roles learned from, and the machine: for each state
    the roles that may follow and the state they lead to."""

    start: str = "<|im_start|>"
    role_end: str = "\n"
    end: str = "<|im_end|>"
    turn_end: str = "\n"
    learned: tuple[str, ...] = ("assistant",)
    first: str = "begin"
    accepting: tuple[str, ...] = ("answered",)
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "begin": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )

    def __post_init__(self):
        for mark in (self.start, self.end):
            if not mark.startswith("<|") or self.role_end != "\n":
                raise ValueError("control strings start with <| and a line ends the role")

    @property
    def states(self) -> list[str]:
        return sorted({self.first, *self.moves, *(s for m in self.moves.values() for s in m.values())})


CHATML = Template()
FAILED = -1


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role stands on one line: its line ends become ``\\n``, its backslashes two."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def segments(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """``turns`` with ``segments``, an array of ``(text, loss)``: the opening of
    the turn, its text, its close. Null texts and roles count as empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    piece = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    return turns.withColumn(
        "segments",
        F.array(
            piece(F.concat(F.lit(template.start), escape_role(role), F.lit(template.role_end)), no),
            piece(escape(text), role.isin(*template.learned)),
            piece(F.lit(template.end + template.turn_end), no),
        ),
    )


def _next_state(state: Column, role: Column, template: Template) -> Column:
    """Number of the next state; a role that may not follow leads to FAILED."""
    number = {s: i for i, s in enumerate(template.states)}
    moves = [
        F.lit(x)
        for s, m in template.moves.items()
        for r, to in m.items()
        for x in (f"{number[s]}:{r}", number[to])
    ]
    table = F.create_map(*moves)
    return F.coalesce(F.try_element_at(table, F.concat(state.cast("string"), F.lit(":"), role)), F.lit(FAILED))


def validate(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """``(conv_id, n_turns, valid)``: whether the turns, in order, are a run of
    the machine that ends in an accepting state.

    Turns with the same number follow each other by role, then text.
    """
    role = F.coalesce("role", F.lit("")).alias("role")
    row = F.struct("turn", role, F.col("text").alias("text"))
    block = F.expr(f"turn div {BLOCK}").alias("block")
    n = len(template.states)
    blocks = turns.groupBy("conv_id", block).agg(
        F.transform(F.sort_array(F.collect_list(row)), lambda t: t["role"]).alias("roles")
    )
    step = lambda s, r: _next_state(s, r, template)
    effect = F.array(*[F.aggregate("roles", F.lit(i), step) for i in range(n)])
    effects = blocks.select("conv_id", "block", F.size("roles").alias("k"), effect.alias("effect"))
    whole = effects.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("block", "effect"))).alias("effects"),
        F.sum("k").alias("n_turns"),
    )
    begin = F.lit(template.states.index(template.first))
    end = F.aggregate(
        "effects",
        begin,
        lambda s, e: F.when(s == FAILED, F.lit(FAILED)).otherwise(F.get(e["effect"], s)),
    )
    accepting = [template.states.index(s) for s in template.accepting]
    return whole.select("conv_id", F.col("n_turns").cast("bigint"), end.isin(*accepting).alias("valid"))


def format_chat(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """``(conv_id, segments, formatted, valid)`` per conversation.

    ``segments`` is the array of ``(text, loss)`` in the order of turns,
    ``formatted`` their texts joined. Conversations that the machine rejects are
    formatted too, with ``valid`` false. Order: turn number (null first), then
    role, then text; repeated rows are repeated turns. Null roles and texts are
    empty; rows with a null conv_id are one conversation. Only conv_id, turn,
    role and text are read. An empty table gives an empty one.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    cut = segments(turns, template)
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("r"), F.col("text").alias("t"), "segments")
    gathered = cut.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    parts = gathered.select("conv_id", F.flatten(F.transform("rows", lambda x: x["segments"])).alias("segments"))
    checked = validate(turns, template).select(F.col("conv_id").alias("of"), "valid")
    joined = parts.join(checked, parts["conv_id"].eqNullSafe(checked["of"]))
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return joined.select("conv_id", "segments", text.alias("formatted"), "valid")


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """Array of ``(role, text)`` read back from a formatted conversation."""
    quoted = r"\Q" + template.start + r"\E"
    turns = F.filter(F.split(formatted, quoted), lambda p, i: i > 0)
    close = len(template.end + template.turn_end)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, template.role_end, 1)
        rest = F.length(role) + F.lit(len(template.role_end))
        text = piece.substr(rest + 1, F.length(piece) - rest - F.lit(close))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def learned_text(segments_: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    kept = F.filter(segments_, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"])), "")
