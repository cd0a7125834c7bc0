"""Chat formatting by a declarative template and a finite-state machine over roles.

Native: DataFrame functions only. A conversation becomes one row, because its text is
one value; rows are gathered by one shuffle on conv_id and nothing else is moved.

Defined results: a null text counts as empty, a null or unknown role is kept and makes
the conversation invalid, turns sort by (turn, role, text) with nulls first, repeated rows are
repeated turns, a null conv_id is a conversation of its own, an empty table gives no rows and
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of


@dataclass(frozen=True)
class Role:
    """A role's label in the output, whether its text counts for the loss, and the states after which it may speak."""

    label: str
    loss: bool
    after: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    """Marks of a turn: head, label, colon, text, close. escape goes before any mark inside a text."""

    head: str = "### "
    colon: str = ": "
    close: str = "</turn>\n"
    control: tuple[str, ...] = ("### ", "</turn>")
    escape: str = "\\"
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    other: str = "Other/"
    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("System", False, ("start",)),
            "user": Role("User", False, ("start", "system", "assistant")),
            "assistant": Role("Assistant", True, ("user",)),
        }
    )

    def __post_init__(self) -> None:
        for mark in self.control:
            if len(mark) < 2 or any(mark.startswith(mark[k:]) for k in range(1, len(mark))):
                raise ValueError(f"a control string must have two characters and not overlap itself: {mark!r}")
        if not any(self.close.startswith(mark) for mark in self.control):
            raise ValueError("the closing mark must begin with a control string")

    def escaped(self, text: Column) -> Column:
        """text with no control string left in it: each gets the escape after its first character, and escapes are doubled."""
        text = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        for mark in self.control:
            text = F.replace(text, F.lit(mark), F.lit(mark[0] + self.escape + mark[1:]))
        return text

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, f"(?s)\\Q{self.escape}\\E(.)", "$1")

    def label(self, role: Column) -> Column:
        """A known role's label, or else the role itself, escaped, behind the mark of other roles."""
        own = F.replace(self.escaped(F.coalesce(role, F.lit(""))), F.lit(":"), F.lit(self.escape + ":"))
        out = F.concat(F.lit(self.other), own)
        for name, it in self.roles.items():
            out = F.when(role == name, F.lit(it.label)).otherwise(out)
        return out

    def role_of(self, label: Column) -> Column:
        out = self.unescaped(F.substr(label, F.lit(len(self.other) + 1)))
        for name, it in self.roles.items():
            out = F.when(label == it.label, F.lit(name)).otherwise(out)
        return out

    def loss(self, role: Column) -> Column:
        return F.coalesce(role.isin(*[n for n, it in self.roles.items() if it.loss]), F.lit(False))

    def transitions(self) -> Column:
        """The machine's table: state|role to the next state, which is the role that spoke."""
        pairs = [F.lit(x) for name, it in self.roles.items() for was in it.after for x in (f"{was}|{name}", name)]
        return F.create_map(*pairs)


def format_chats(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """Rows (conv_id, turn, role, text) to one row a conversation.

    Columns: conv_id, n_turns, valid (the machine accepts all turns and ends in an accepting
    state), first_bad_turn (0-based position of the first turn that it refuses, else null),
    segments (text, loss; their texts joined are the output) and formatted.
    """
    t = template or Template()
    turns = rows.select("conv_id", F.struct("turn", "role", text_of("text").alias("text")).alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))

    def step(state: Column, x: Column) -> Column:
        role = F.coalesce(x["role"], F.lit(""))
        to = F.try_element_at(t.transitions(), F.concat(state["at"], F.lit("|"), role))
        return F.struct(
            F.coalesce(to, role).alias("at"),
            F.when(state["bad"].isNull() & to.isNull(), state["n"]).otherwise(state["bad"]).alias("bad"),
            (state["n"] + 1).alias("n"),
        )

    first = F.struct(F.lit(t.start).alias("at"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("n"))

    def parts(x: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(t.head), t.label(x["role"]), F.lit(t.colon)), F.lit(False)),
            piece(t.escaped(x["text"]), t.loss(x["role"])),
            piece(F.lit(t.close), F.lit(False)),
        )

    ran = turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("turns", first, step).alias("end"),
        F.flatten(F.transform("turns", parts)).alias("segments"),
    )
    return ran.select(
        "conv_id",
        "n_turns",
        (F.col("end.bad").isNull() & F.col("end.at").isin(*t.accept)).alias("valid"),
        F.col("end.bad").alias("first_bad_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) that formatted text holds, unescaped."""
    t = template or Template()
    pieces = F.split(formatted, f"\\Q{t.close}\\E", -1)

    def parse(piece: Column) -> Column:
        label = F.regexp_extract(piece, f"(?s)^\\Q{t.head}\\E((?:[^:\\\\]++|\\\\.)*+)\\Q{t.colon}\\E", 1)
        text = F.substr(piece, F.length(label) + len(t.head) + len(t.colon) + 1)
        return F.struct(t.role_of(label).alias("role"), t.unescaped(text).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), parse)


def read_loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped and joined with nothing between."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: t.unescaped(s["text"])), "")
