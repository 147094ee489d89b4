"""Repair of damaged conversations by rank-convergence parallel Viterbi.

A conversation shall read ``(s?(ua)+)?`` in its roles' initials. Every row is
kept, given another role or deleted, and empty turns may be inserted; the
cheapest edits are asked for, of equal ones those whose initials sort first.
Four states know all that matters of the turns before: nothing yet, after s,
after u, after a. A row turns the cost vector of the states after it into that
of the states before it (backward Viterbi).

The rows are range-sorted over all tasks, so a conversation of any length is
cut into chunks, one for each partition it reaches:

1. every chunk runs backward from a speculative vector;
2. fix-up passes hand each chunk the vector that its successor found; a chunk
   reruns until old and new vector differ by a constant only, which leaves
   everything before unchanged. Passes end when no chunk's vector changes;
3. with the vectors stitched, each cut chunk maps the state it is entered with
   to the one it is left with, the maps are chained, and every chunk traces its
   least edits from its entry on.

Only the first and last chunk of a partition can be cut, so what the driver
holds is a few numbers for each partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

LEFT_CUT, REROLED, DELETED, INSERTED = 5, 1, 2, 5
"""Costs: leaving a truncated row in, another role, deletion, an inserted turn."""

#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that a changed or inserted turn has in each state.
WANTED = ("u", "u", "a", "u")
ROLE = {"u": "user", "a": "assistant"}
AHEAD = tuple(STEP[q, r] for q, r in enumerate(WANTED))

Vector = tuple[int, int, int, int]
SPECULATIVE: Vector = (0, 0, 0, 0)
#: After the last row: the turns that must still be inserted.
FINAL: Vector = (0, 2 * INSERTED, INSERTED, 0)

#: Kinds of rows: 0 must go; else 1 + 2 x (place of the initial in "sua", 3 for others) + (1 if truncated).
INITIALS = "sua"


class Viterbi:
    """Backward steps and trace steps, each worked out once: normalised vectors x kinds of rows are few."""

    def __init__(self) -> None:
        self.backs: dict[tuple[Vector, int], Vector] = {}
        self.traces: dict[tuple[Vector, int, int], tuple[str, str, str, int, int]] = {}

    @staticmethod
    def choices(kind: int, q: int) -> list[tuple[str, str, int, int]]:
        """(edit, role's initial, state after, cost) of the edits of a row, in the order of their names."""
        found = [("D", "", q, DELETED)]
        if kind:
            own, cut = (kind - 1) // 2, LEFT_CUT * ((kind - 1) % 2)
            if own < 3 and (q, INITIALS[own]) in STEP:
                found.append(("K", INITIALS[own], STEP[q, INITIALS[own]], cut))
            found.append(("R", WANTED[q], AHEAD[q], REROLED + cut))
        return found

    def full(self, after: Vector, kind: int) -> Vector:
        """Costs to the end before the row, insertions in front of it allowed."""
        row = [min(cost + after[to] for _, _, to, cost in self.choices(kind, q)) for q in range(4)]
        return tuple(min(row[q], INSERTED + row[AHEAD[q]], 2 * INSERTED + row[AHEAD[AHEAD[q]]]) for q in range(4))

    def back(self, after: Vector, kind: int) -> Vector:
        """The same less its least entry: vectors that differ by a constant are one."""
        found = self.backs.get((after, kind))
        if found is None:
            whole = self.full(after, kind)
            found = self.backs[after, kind] = tuple(x - min(whole) for x in whole)
        return found

    def trace(self, after: Vector, kind: int, q: int) -> tuple[str, str, str, int, int]:
        """(roles inserted before the row, its edit, its new initial, state after, cost): the least names among the cheapest."""
        found = self.traces.get((after, kind, q))
        if found is None:
            before, state, spent, whole = "", q, 0, self.full(after, kind)
            while True:
                fits = {e: (role, to, cost) for e, role, to, cost in self.choices(kind, state) if cost + after[to] == whole[state]}
                insert = INSERTED + whole[AHEAD[state]] == whole[state]
                edit = min([*fits, "I"] if insert else fits)
                if edit != "I":
                    role, to, cost = fits[edit]
                    break
                before, spent, state = before + WANTED[state], spent + INSERTED, AHEAD[state]
            found = self.traces[after, kind, q] = before, edit, role, to, spent + cost
        return found


def closing(q: int) -> str:
    """Roles to insert after the last row."""
    roles = ""
    while FINAL[q]:
        roles, q = roles + WANTED[q], AHEAD[q]
    return roles


def _is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def _is_cut(text: Column) -> Column:
    """The last character that is no blank ends no sentence."""
    return ~F.right(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), F.lit(1)).isin(".", "!", "?")


def keyed(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, ha, hb, text): the rows with 128 bits of hash for their text; a null role or text is one blank."""
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text")
    )
    return rows.select("conv_id", "turn", "role", F.xxhash64("text").alias("ha"), F.xxhash64(F.lit(7), "text").alias("hb"), "text")


def faults(rows: DataFrame) -> DataFrame:
    """One narrow row for each distinct row of :func:`keyed`: copies, blank, later (equal to an earlier one), truncated.

    Equal rows follow each other, so all but one of them are duplicates, and a
    row with equal role and text at another turn is a later one: no ordered
    pass over a conversation is needed.
    """
    same = ["conv_id", "role", "ha", "hb"]
    distinct = rows.groupBy("conv_id", "turn", "role", "ha", "hb").agg(
        F.count("*").alias("copies"), F.first(_is_blank(F.col("text"))).alias("blank"), F.first(_is_cut(F.col("text"))).alias("cut")
    )
    order = F.struct(F.col("turn").isNotNull().alias("late"), "turn")
    again = distinct.groupBy(*same).agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(*[F.col(c).alias(f"_{c}") for c in same], F.col("first.turn").alias("_turn"), F.lit(True).alias("_again"))
    joined = distinct.join(again, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same], "left")
    later = F.coalesce(F.col("_again") & ~F.col("turn").eqNullSafe(F.col("_turn")), F.lit(False))
    return joined.select("conv_id", "turn", "role", "ha", "hb", "copies", "blank", (~F.col("blank") & later).alias("later"), (~F.col("blank") & ~later & F.col("cut")).alias("truncated"))


def _placed(found: DataFrame) -> DataFrame:
    """Rows in order over range partitions, fixed by a checkpoint, with ``pos`` (partition and place) and ``kind``."""
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "ha", "hb"]
    initial = F.left("role", F.lit(1))
    own = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    kind = F.when(F.col("blank") | F.col("later"), 0).otherwise(1 + 2 * own + F.col("truncated").cast("int"))
    rows = found.withColumns({"kind": kind.cast("int"), "initial": initial})
    return checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], bool, bool]]:
    """Runs of one conversation in a partition: (pieces, first of the partition, last of it)."""
    held: list[pa.RecordBatch] = []
    name, first = None, True
    for batch in batches:
        at = 0
        for conv, run in groupby(batch.column("conv_id").to_pylist()):
            n = sum(1 for _ in run)
            if held and conv != name:
                yield held, first, False
                held, first = [], False
            name = conv
            held.append(batch.slice(at, n))
            at += n
    if held:
        yield held, first, True


def _column(pieces: list[pa.RecordBatch], name: str) -> list:
    return [x for p in pieces for x in p.column(name).to_pylist()]


def _edge_pass(placed: DataFrame, ends: dict[int, list[tuple[Vector, Vector]]] | None) -> list:
    """Run edge chunks backward; a row for each of them.

    ends: None: the first and the last chunk of every partition, from the
    speculative vector and from the final one. Else, by the chunk's first
    ``pos``: the vector it had and the one it gets; the run stops where both
    have become one.
    """
    given = placed.sparkSession.sparkContext.broadcast(ends)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi, rows = Viterbi(), []
        for pieces, first, last in _chunks(batches):
            if not (first or last):
                continue
            at = pieces[0].column("pos")[0].as_py()
            if given.value is not None and at not in given.value:
                continue
            kinds = _column(pieces, "kind")
            old, new = (SPECULATIVE, FINAL) if given.value is None else given.value[at]
            met = False
            for kind in reversed(kinds):
                old, new = viterbi.back(old, kind), viterbi.back(new, kind)
                if met := old == new and given.value is not None:
                    break
            initials = pieces[0].column("initial")[0].as_py(), pieces[-1].column("initial")[-1].as_py()
            rows.append((at, repr(pieces[0].column("conv_id")[0].as_py()), list(old), list(new), met, not any(kinds), *initials))
        yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in rows], schema=shape)

    shape = pa.schema([("pos", pa.int64()), ("conv", pa.string()), ("old", pa.list_(pa.int32())), ("new", pa.list_(pa.int32())), ("met", pa.bool_()), ("idle", pa.bool_()), ("first", pa.string()), ("last", pa.string())])
    return placed.mapInArrow(task, "pos long, conv string, old array<int>, new array<int>, met boolean, idle boolean, first string, last string").collect()


def _chains(edges: list) -> list[list]:
    """Edge chunks of conversations that reach several partitions, in order."""
    chains: list[list] = []
    before = None
    for e in sorted(edges, key=lambda e: e.pos):
        if before is not None and e.conv == before.conv and e.pos >> 33 != before.pos >> 33:
            chains[-1].append(e)
        else:
            chains.append([e])
        before = e
    return [c for c in chains if len(c) > 1]


def stitched(placed: DataFrame) -> tuple[dict[int, tuple[Vector, int, str | None, bool]], int]:
    """For each cut chunk, by its first ``pos``: vector after it, state it is entered with, initial before it, whether it ends its conversation.

    Also the number of fix-up passes.
    """
    chains = _chains(_edge_pass(placed, None))
    got, out = {}, {}
    for chain in chains:
        for e in chain:
            got[e.pos], out[e.pos] = SPECULATIVE, tuple(e.old)
        got[e.pos], out[e.pos] = FINAL, tuple(e.new)
    passes = 0
    while True:
        rerun: dict[int, tuple[Vector, Vector]] = {}
        for chain in chains:
            for e, after in reversed(list(zip(chain, chain[1:]))):
                if got[e.pos] != out[after.pos]:
                    if e.idle:  # rows that all must go add a constant: no rerun
                        got[e.pos] = out[e.pos] = out[after.pos]
                    else:
                        rerun[e.pos] = got[e.pos], out[after.pos]
        if not rerun:
            break
        passes += 1
        for r in _edge_pass(placed, rerun):
            got[r.pos] = rerun[r.pos][1]
            if not r.met:
                out[r.pos] = tuple(r.new)
    entry = _entries(placed, chains, got)
    cut = {}
    for chain in chains:
        for before, e in zip([None, *chain], chain):
            cut[e.pos] = got[e.pos], entry[e.pos], before and before.last, e is chain[-1]
    return cut, passes


def _entries(placed: DataFrame, chains: list[list], got: dict[int, Vector]) -> dict[int, int]:
    """The state that each cut chunk is entered with, from the chunks' maps of states."""
    if not chains:
        return {}
    given = placed.sparkSession.sparkContext.broadcast(got)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi, at, left = Viterbi(), [], []
        for pieces, _, _ in _chunks(batches):
            pos = pieces[0].column("pos")[0].as_py()
            if pos in given.value:
                kinds, after = _column(pieces, "kind"), _vectors(viterbi, _column(pieces, "kind"), given.value[pos])
                states = list(range(4))
                for kind, vector in zip(kinds, after):
                    states = [viterbi.trace(vector, kind, q)[3] for q in states]
                at.append(pos)
                left.append(states)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(left, pa.list_(pa.int32()))], names=["pos", "left"])

    maps = {r.pos: r.left for r in placed.mapInArrow(task, "pos long, left array<int>").collect()}
    entry = {}
    for chain in chains:
        q = 0
        for e in chain:
            entry[e.pos], q = q, maps[e.pos][q]
    return entry


def _vectors(viterbi: Viterbi, kinds: list[int], end: Vector) -> list[Vector]:
    """The vector after each row."""
    found = [end]
    for kind in reversed(kinds[1:]):
        found.append(viterbi.back(found[-1], kind))
    return found[::-1]


EDITS = "before string, edit string, new string, after string, cost long, illegal long"


def edits(rows: DataFrame) -> DataFrame:
    """The edits of every distinct row of :func:`keyed`.

    conv_id, turn, role, ha, hb, copies, blank, later, truncated, pos (its
    place), and: before (initials of the turns inserted before it), edit (D, K
    or R; further copies are deleted), new (its initial, if it stays), after
    (turns inserted behind the conversation's last row), cost, illegal
    (neighbouring initials that may not follow each other).

    Null conversations are one conversation, null turns come first; rows of
    equal turn stand by role and text hash. Roles that begin with none of s, u
    and a can not be kept as they are. An empty table gives no rows.
    """
    placed = _placed(faults(rows))
    cut, _ = stitched(placed)
    given = placed.sparkSession.sparkContext.broadcast(cut)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi, legal = Viterbi(), {"su", "ua", "au"}
        for pieces, _, _ in _chunks(batches):
            end, q, before, ends = given.value.get(pieces[0].column("pos")[0].as_py(), (FINAL, 0, None, True))
            after = iter(_vectors(viterbi, _column(pieces, "kind"), end))
            for k, piece in enumerate(pieces):
                out: list[tuple] = []
                kinds, copies, initials = (piece.column(c).to_pylist() for c in ("kind", "copies", "initial"))
                for kind, n, initial in zip(kinds, copies, initials):
                    put, edit, new, q, cost = viterbi.trace(next(after), kind, q)
                    illegal = n - 1 + (before is not None and before + initial not in legal)
                    out.append((put, edit, new, "", cost + DELETED * (n - 1), illegal))
                    before = initial
                if ends and k == len(pieces) - 1:
                    tail = closing(q)
                    out[-1] = (*out[-1][:3], tail, out[-1][4] + INSERTED * len(tail), out[-1][5])
                made = [pa.array(x, t) for x, t in zip(zip(*out), [pa.string()] * 4 + [pa.int64()] * 2)]
                yield pa.RecordBatch.from_arrays([*piece.columns, *made], names=[*piece.schema.names, "before", "edit", "new", "after", "cost", "illegal"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    return placed.mapInArrow(task, f"{schema}, {EDITS}")


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of :func:`edits` with ``text``, ``role_after`` (null: deleted).

    A row that stays has its text, a deleted one none. The texts meet their
    edits by conversation, turn, role and text hash, so a long conversation is
    spread over all tasks.
    """
    rows = keyed(turns, conv, turn, role, text)
    found = edits(rows)
    keys = ["conv_id", "turn", "role", "ha", "hb"]
    texts = rows.groupBy(*keys).agg(F.first("text").alias("text")).withColumnsRenamed({k: f"_{k}" for k in keys})
    met = found.join(texts, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    stays = F.col("edit") != "D"
    named = F.when(F.col("edit") == "K", F.col("role")).when(F.col("new") == "u", "user").when(F.col("new") == "a", "assistant")
    return met.select(*found.columns, F.when(stays, F.col("text")).alias("text"), F.when(stays, named).alias("role_after"))


SUMS = ("blank", "duplicate", "truncated", "illegal", "cost")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of :func:`repaired` rows.

    A digest is one sequential function of a conversation, so its rows go to
    one task; they stream through it in order and are not gathered.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    extra = F.col("copies") - 1
    lone = F.when(F.col("blank"), 0).otherwise(extra + F.col("later").cast("int"))
    slim = rows.select(
        "conv_id", "pos", F.col("turn").cast("decimal(38,0)").cast("string").alias("turn"), "before", "edit", "after", extra.alias("extra"), "role_after", "text",
        F.when(F.col("blank"), F.col("copies")).otherwise(0).alias("blank"), lone.alias("duplicate"), F.col("truncated").cast("long").alias("truncated"), "illegal", "cost",
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started = None, False
        sums, turns, audit, sha, lines = [0] * 5, [None, None, 0], [], hashlib.sha256(), 0

        def put(line: str) -> None:
            nonlocal lines
            sha.update(("\n" if lines else "").encode() + line.encode())
            lines += 1

        def ended() -> dict:
            gaps = int(turns[1]) - int(turns[0]) + 1 - turns[2] if turns[2] else 0
            return {"conv_id": now, "gaps": min(gaps, 2**63 - 1), **dict(zip(SUMS, sums)), "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if not started or r["conv_id"] != now:
                    if started:
                        done.append(ended())
                    now, started = r["conv_id"], True
                    sums, turns, audit, sha, lines = [0] * 5, [None, None, 0], [], hashlib.sha256(), 0
                if r["turn"] is not None and r["turn"] != turns[1]:
                    turns = [r["turn"] if turns[0] is None else turns[0], r["turn"], turns[2] + 1]
                sums = [a + r[c] for a, c in zip(sums, SUMS)]
                audit.append("I" * len(r["before"]) + r["edit"] + "D" * r["extra"] + "I" * len(r["after"]))
                for x in r["before"]:
                    put(f"{ROLE[x]}:")
                if r["role_after"] is not None:
                    put(f"{r['role_after']}:{r['text']}")
                for x in r["after"]:
                    put(f"{ROLE[x]}:")
            yield pa.RecordBatch.from_pylist(done, schema=shape(batch))
        if started:
            yield pa.RecordBatch.from_pylist([ended()], schema=shape(batch))

    def shape(batch: pa.RecordBatch) -> pa.Schema:
        return pa.schema([("conv_id", batch.schema.field("conv_id").type), ("gaps", pa.int64()), *[(c, pa.int64()) for c in SUMS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.mapInArrow(task, f"conv_id {kind}, gaps long, " + ", ".join(f"{c} long" for c in SUMS) + ", audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """The damage of the query's contract, by crc32 of ``conv_id:turn``; nulls are one blank."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))), F.lit(20))
    rows = turns.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def report(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """:func:`digests` of the repaired ``rows``, and a line of zeros for conversations of ``turns`` that have none."""
    found = digests(repaired(rows))
    every = turns.select(F.col("conv_id").alias("_conv")).distinct()
    joined = every.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *SUMS)]
    return joined.select(
        F.col("_conv").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
