"""Chat formatting from a declarative template, with loss flags and its way back.

The template gives each role its marks, whether its text is learned, and which
roles may come next. A conversation becomes segments (mark, text, mark) with a
loss flag each. Control strings inside texts are escaped, so the formatted
conversation can be read back exactly. Turn order is checked by the finite-state
machine that the template describes.

Turns are put into pieces by their number, formatted piece by piece, and only
the pieces of a conversation come together: the machine runs each piece from
all of its states, so that whole conversations are compositions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns of one piece; turn numbers n * PIECE .. n * PIECE + PIECE - 1.
PIECE = 256


@dataclass(frozen=True)
class Role:
    """Marks around a text, whether it is learned, and the roles that may follow."""

    opens: str
    closes: str
    learned: bool
    then: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    """start: roles that may begin a conversation; ends: roles that may end it; other: marks of unknown roles
    (their name goes between ``names`` and the text)."""

    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("<<SYS>> ", " <</SYS>>", False, ("user",)),
            "user": Role("[INST] ", " [/INST]", False, ("assistant",)),
            "assistant": Role("<s> ", " </s>", True, ("user",)),
        }
    )
    start: tuple[str, ...] = ("system", "user")
    ends: tuple[str, ...] = ("assistant", "user")
    other: Role = Role("[ROLE] ", " [/ROLE]", False, ())
    names: str = " [NAME] "
    escape: str = "\\"

    def controls(self) -> list[str]:
        """All control strings, without the blanks around them, in order of their escape number."""
        every = [x for r in (*self.roles.values(), self.other) for x in (r.opens, r.closes)] + [self.names]
        return list(dict.fromkeys(x.strip() for x in every))


def escaped(text: Column, template: Template) -> Column:
    """Escape character doubled as e + "e", control string k as e + its letter: no control string is left."""
    e = template.escape
    out = F.replace(text, F.lit(e), F.lit(e + "e"))
    for k, control in enumerate(template.controls()):
        out = F.replace(out, F.lit(control), F.lit(e + chr(ord("A") + k)))
    return out


def unescaped(text: Column, template: Template) -> Column:
    """What ``escaped`` was given: the marks cannot overlap, so the order does not matter but for the escape itself."""
    e = template.escape
    out = text
    for k, control in enumerate(template.controls()):
        out = F.replace(out, F.lit(e + chr(ord("A") + k)), F.lit(control))
    return F.replace(out, F.lit(e + "e"), F.lit(e))


def _segments(role: Column, text: Column, template: Template) -> Column:
    """(text, loss) segments of a turn."""
    segment = lambda t, loss: F.struct(t.alias("text"), F.lit(loss).alias("loss"))
    body = escaped(text, template)
    other = template.other
    out = F.array(
        segment(F.concat(F.lit(other.opens), escaped(role, template), F.lit(template.names)), False),
        segment(body, other.learned),
        segment(F.lit(other.closes), False),
    )
    for name, r in template.roles.items():
        out = F.when(role == name, F.array(segment(F.lit(r.opens), False), segment(body, r.learned), segment(F.lit(r.closes), False))).otherwise(out)
    return out


def _machine(template: Template) -> tuple[list[str], dict[tuple[int, str], int]]:
    """States (0: start, one for each role, last: refused) and the transitions that are allowed."""
    names = list(template.roles)
    moves = {(0, r): 1 + names.index(r) for r in template.start}
    for k, (_, role) in enumerate(template.roles.items()):
        moves |= {(k + 1, r): 1 + names.index(r) for r in role.then}
    return ["", *names, "refused"], moves


def _run(roles: Column, state: Column, template: Template) -> Column:
    states, moves = _machine(template)
    refused = F.lit(len(states) - 1)

    def move(s: Column, role: Column) -> Column:
        return reduce(lambda out, m: F.when((s == m[0][0]) & (role == m[0][1]), m[1]).otherwise(out), moves.items(), refused)

    return F.aggregate(roles, state, move)


def segments(turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn",
             role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, piece, segments, ends): the formatted turns of each piece in order, and where the machine ends from
    each state.

    Turns are ordered by number (nulls first), equal numbers by role and text;
    repeated rows are turns of their own. A null text is empty, a null role is
    the unknown role "". Null conversation ids form one conversation.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.floor(F.col(turn_col) / PIECE).alias("piece"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    pieces = rows.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    states = _machine(template)[0]
    roles = F.transform("turns", lambda t: t["role"])
    return pieces.select(
        "conv_id", "piece",
        F.flatten(F.transform("turns", lambda t: _segments(t["role"], t["text"], template))).alias("segments"),
        F.array(*[_run(roles, F.lit(s), template) for s in range(len(states))]).alias("ends"),
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """(role, text, loss) of the turns of a formatted string."""
    marks = [(name, r) for name, r in template.roles.items()] + [(None, template.other)]
    quoted = lambda s: "\\Q" + s + "\\E"
    closing = "|".join(quoted(r.closes) for _, r in marks)
    turns = F.regexp_extract_all(formatted, F.lit(f"(?s)(?:{'|'.join(quoted(r.opens) for _, r in marks)}).*?(?:{closing})"), F.lit(0))

    def turn(t: Column) -> Column:
        def part(name, r: Role) -> Column:
            inner = F.substring(t, len(r.opens) + 1, F.length(t) - len(r.opens) - len(r.closes))
            if name is not None:
                return F.struct(F.lit(name).alias("role"), unescaped(inner, template).alias("text"), F.lit(r.learned).alias("loss"))
            at = F.instr(inner, F.lit(template.names))
            own = F.substring(inner, F.lit(1), at - 1)
            rest = F.substring(inner, at + len(template.names), F.length(inner))
            return F.struct(unescaped(own, template).alias("role"), unescaped(rest, template).alias("text"), F.lit(r.learned).alias("loss"))

        out = part(None, template.other)
        for name, r in template.roles.items():
            out = F.when(F.startswith(t, F.lit(r.opens)), part(name, r)).otherwise(out)
        return out

    return F.transform(turns, turn)


def digests(pieces: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, read back from its formatted pieces: n_turns, digests, lengths, and whether the
    order of its turns is valid.

    A digest needs a whole conversation in one row; its pieces are assembled
    before, so a long one arrives as few rows.
    """
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    # Segments carry the loss; the mask of the formatted text is checked against what is read back.
    rows = pieces.select("conv_id", "piece", text.alias("formatted"), "ends").withColumn("turns", read_back(F.col("formatted"), template))
    learned = F.filter("turns", lambda t: t["loss"])
    whole = rows.select(
        "conv_id", "piece", "ends", F.size("turns").cast("long").alias("n"), F.length("formatted").cast("long").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all"),
        F.array_join(F.transform(learned, lambda t: t["text"]), "").alias("learned"),
    )
    grouped = whole.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sum(F.length("learned")).cast("long").alias("loss_chars"),
        F.sort_array(F.collect_list(F.struct("piece", "all", "learned", "ends"))).alias("p"),
    )
    join = lambda name: F.array_join(F.transform("p", lambda x: x[name]), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    states = _machine(template)[0]
    last = F.aggregate("p", F.lit(0), lambda s, x: F.get(x["ends"], s))
    return grouped.select(
        "conv_id", "n_turns", digest(join("all")).alias("turns_sha256"), "loss_chars", digest(join("learned")).alias("loss_sha256"),
        "formatted_chars", last.isin([states.index(r) for r in template.ends]).alias("valid"),
    )
