import hashlib
import random
import re
import zlib

import pytest

from panelwright.llm import turn_repair as T

BLANKS = " \t\n\x0b\f\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def first_faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        solid = text.strip(BLANKS)
        found.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows, found):
    """Forward search over (row, initials' state) with whole audits; knows nothing of backward vectors."""
    rule = re.compile(r"(s?(ua)+)?")

    def fits(initials):  # can the initials so far be completed?
        return any(rule.fullmatch(initials + tail) for tail in ("", "a", "ua"))

    best = {"": (0, "", ())}

    def state(initials):  # a short text that can be completed in the same ways
        return "ua" if initials[-1:] == "a" else initials[-1:]

    def better(table, key, entry):
        if key not in table or entry[:2] < table[key][:2]:
            table[key] = entry

    def inserted(table):
        for _ in range(3):
            for key, (cost, audit, out) in list(table.items()):
                for role in ("user", "assistant"):
                    if fits(key + role[0]):
                        better(table, state(key + role[0]), (cost + 5, audit + "I", (*out, f"{role}:")))
        return table

    for (_, _, role, text), fault in zip(rows, found):
        after = {}
        for key, (cost, audit, out) in inserted(best).items():
            better(after, key, (cost + 2, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                cut = 5 * (fault == "truncated")
                if role[:1] in ("s", "u", "a") and fits(key + role[:1]):
                    better(after, state(key + role[:1]), (cost + cut, audit + "K", (*out, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    if fits(key + to[0]):
                        better(after, state(key + to[0]), (cost + cut + 1, audit + "R", (*out, f"{to}:{text}")))
        best = after
    ends = [v for k, v in inserted(best).items() if k in ("", "ua")]
    return min(ends, key=lambda v: v[:2])


def plain(rows):
    """All columns of the contract for the rows of one conversation, in order."""
    found = first_faults(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest(rows, found)
    sha = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, sha


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))


def as_plain(r):
    return r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256


SCHEMA = "conv_id long, turn long, role string, text string"


def some_conversations(n=150):
    draw, rows = random.Random(4), []
    for conv in range(n):
        for turn in range(draw.randrange(9)):
            role = draw.choice(["user", "assistant"] * 4 + ["system", "tool", "", "sage"]) if draw.random() < 0.5 else ("user", "assistant")[turn % 2]
            text = draw.choice(["Hi.", "So?", "yes", "No! ", " ", "", "Ünd…", f"t{turn}.", "x.\x85"])
            rows.append((conv, turn * draw.choice([1, 1, 3]) + 10 * turn, role, text))
    return rows


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay apart, so that conversations are cut."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repairs_equal_a_forward_search(uncoalesced):
    rows = some_conversations()
    got = {r.conv_id: r for r in T.digests(T.repaired(uncoalesced.createDataFrame(rows, SCHEMA))).collect()}
    for conv in {r[0] for r in rows}:
        own = in_order([r for r in rows if r[0] == conv])
        assert as_plain(got[conv]) == plain(own), own
    assert len(got) == len({r[0] for r in rows})


def test_exhaustive_on_short_conversations():
    """Vectors and traces against every audit of up to three rows and two inserted turns in each gap."""
    viterbi = T.Viterbi()

    def every(kinds, q):
        """(cost, audit) of all ways from state q."""
        for put in range(3):
            state, spent = q, 0
            for _ in range(put):
                state, spent = T.AHEAD[state], spent + T.INSERTED
            if not kinds:
                if state in (0, 3):
                    yield spent, "I" * put
                continue
            for edit, _, to, cost in T.Viterbi.choices(kinds[0], state):
                for rest, audit in every(kinds[1:], to):
                    yield spent + cost + rest, "I" * put + edit + audit

    for n in range(4):
        for code in range(9**n):
            kinds = [code // 9**k % 9 for k in range(n)]
            q, cost, audit = 0, 0, ""
            for kind, after in zip(kinds, T._vectors(viterbi, kinds, T.FINAL) if kinds else []):
                before, edit, _, q, spent = viterbi.trace(after, kind, q)
                cost, audit = cost + spent, audit + "I" * len(before) + edit
            tail = T.closing(q)
            assert (cost + T.INSERTED * len(tail), audit + "I" * len(tail)) == min(every(kinds, 0)), kinds


def long_conversation(kind, n=3000):
    draw = random.Random(kind)
    if kind == "alternating":
        return [(1, k, ("user", "assistant")[k % 2], f"t{k}.") for k in range(n)]
    if kind == "copies":
        return [(1, k // 1000, "user", "Same.") for k in range(n)]
    if kind == "blank":
        return [(1, k, "user", " ") for k in range(n)]
    return [(1, k, draw.choice(["user", "assistant", "user", "assistant", "system", "x"]), draw.choice([f"t{k}.", f"t{k}", "", "Same."])) for k in range(n)]


@pytest.mark.parametrize("kind", ["alternating", "copies", "blank", "mixed"])
def test_one_long_conversation_is_cut_and_stitched(uncoalesced, kind):
    rows = long_conversation(kind)
    around = [(0, 0, "user", "a."), (2, 0, "assistant", "b.")]
    turns = uncoalesced.createDataFrame(around + rows, SCHEMA)
    placed = T._placed(T.faults(T.keyed(turns)))
    cut, passes = T.stitched(placed)
    if kind != "copies":  # three distinct rows need not reach two partitions
        assert len(cut) >= 4
    assert passes <= 2
    got = {r.conv_id: r for r in T.digests(T.repaired(turns)).collect()}
    assert as_plain(got[1]) == plain(in_order(rows))
    assert as_plain(got[0]) == plain(around[:1]) and as_plain(got[2]) == plain(around[1:])


def test_chunks_take_over_exact_vectors(uncoalesced):
    """Whatever the chunks start from, the stitched vectors are those of one backward run."""
    rows = long_conversation("mixed")
    placed = T._placed(T.faults(T.keyed(uncoalesced.createDataFrame(rows, SCHEMA))))
    cut, _ = T.stitched(placed)
    order = placed.orderBy("pos").collect()
    whole = T._vectors(T.Viterbi(), [r.kind for r in order], T.FINAL)
    place = {r.pos: k for k, r in enumerate(order)}
    firsts = sorted(cut)
    for first, following in zip(firsts, [*firsts[1:], None]):
        last = len(order) - 1 if following is None else place[following] - 1
        assert cut[first][0] == whole[last]


def test_query_contract_with_nulls_and_lost_conversations(spark):
    draw = random.Random(9)
    rows = [(conv, turn, ("user", "assistant")[turn % 2], draw.choice(["Yes. No!", "Why", "Same.", None])) for conv in range(80) for turn in range(draw.randrange(1, 7))]
    rows += [(None, None, None, None), (None, 3, "user", "Null conversation."), (500, None, "user", "Null turn."), (500, 1, None, "Null role.")]
    lost = next(k for k in range(1000, 9999) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "Gone."))
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", pos string, kind int")
    got = {r.conv_id: r for r in T.report(turns, T.damaged(turns)).collect()}
    assert set(got) == {r[0] for r in rows}
    after = plain_damage(rows)
    for conv in set(got) - {lost}:
        own = in_order([r for r in after if r[0] == conv])
        assert as_plain(got[conv]) == plain(own), own
    assert as_plain(got[lost]) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_empty_table_and_very_long_text(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert T.report(none, T.damaged(none)).collect() == []
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "." + " " * 300_000 + "x")]
    got = T.digests(T.repaired(spark.createDataFrame(rows, SCHEMA))).first()
    assert as_plain(got) == plain(rows)
