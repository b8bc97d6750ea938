"""Conversation repair against a plain table of costs and whole audits."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest

from gridweave.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, key int, gid string"
GRAMMAR = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, roles and texts) by a table of (cost, audit) for each state, rows being (role, text, fault)."""

    def put(table):
        for _ in range(4):
            for state, (cost, audit, out) in list(table.items()):
                role = "assistant" if state == "u" else "user"
                new = (cost + 5, audit + "I", [*out, (role, "")])
                table[role[0]] = min(table.get(role[0], (10**9,)), new)
        return table

    fits = {"": "su", "s": "u", "u": "a", "a": "u"}
    table = {"": (0, "", [])}
    for role, text, fault in rows:
        now = {}
        for state, (cost, audit, out) in put(table).items():
            options = [(state, (cost + 2, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] and role[:1] in fits[state]:
                    options.append((role[0], (cost + more, audit + "K", [*out, (role, text)])))
                new = "assistant" if state == "u" else "user"
                options.append((new[0], (cost + 1 + more, audit + "R", [*out, (new, text)])))
            for to, x in options:
                now[to] = min(now.get(to, (10**9,)), x)
        table = now
    return min(x for state, x in put(table).items() if state in ("", "a"))


def expected(rows):
    """The contract's columns by conv_id, for damaged rows (conv_id, turn, role, text) in the order of their turns."""
    out = {}
    for conv, group in groupby(rows, lambda r: r[0]):
        group, seen, faults = list(group), set(), []
        for _, _, role, text in group:
            solid = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {r[1] for r in group if r[1] is not None}
        initials = [r[2][:1] for r in group]
        cost, audit, turned = cheapest([(r[2], r[3], f) for r, f in zip(group, faults, strict=True)])
        assert GRAMMAR.fullmatch("".join(r[0] for r, _ in turned))
        said = "\n".join(f"{r}:{t}" for r, t in turned)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def in_order(rows):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return sorted(rows, key=lambda r: ("" if r[0] is None else str(r[0]), r[1] is not None, r[1] or 0, r[2], digest(r[3])))


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        out += [(conv, turn, "user" if n == 4 else role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
    return in_order(out)


def conversations(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", "", None, "Assistant"], ["fine.", "well!", "so?", "cut", " \t\n", "", None, "end. \n", "é 漢", "x" * 3]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(0, 9) if conv != 3 else 60):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.3 else f"say {conv} {turn}{rng.choice('.!?x')}"))
        if conv == 5:
            rows += [(5, 1, "user", "same again.")] * 30 + [(5, 40, "user", "word. " * 20_000)]
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_crossings_are_the_cheapest_and_least(seed):
    rng = random.Random(seed)
    faults = {None: repair.FINE, "truncated": repair.CUT, "blank": repair.GONE}
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for _ in range(150):
        rows = [(rng.choice("suuaaao"), rng.choice([None, None, None, "truncated", "blank"])) for _ in range(rng.randrange(1, 14))]
        codes = "".join(faults[f][repair.INITIALS.index(i)] for i, f in rows)
        last, cost, ending = repair.closing(repair.summary(codes)[0])
        audit = "".join(a for a, _ in repair.segment_edits(codes, repair.START, last)) + ending
        assert (cost, audit) == cheapest([(names[i], "", f) for i, f in rows])[:2]


def test_runs_join_in_any_way():
    rng = random.Random(9)
    for _ in range(100):
        runs = [repair.row_run(rng.choice(repair.FINE + repair.CUT + repair.GONE)) for _ in range(rng.randrange(2, 12))]
        cut = rng.randrange(1, len(runs))
        assert repair.joined([repair.joined(runs[:cut]), repair.joined(runs[cut:])]) == repair.joined(runs)


@pytest.mark.parametrize(("segment", "fan"), [(12, 8), (1, 4)])
def test_damage_and_repair(spark, segment, fan):
    rows = conversations(random.Random(1), 12)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = repair.damage_and_repair(df, segment, fan).collect()
    assert len(got) == len({r[0] for r in rows})
    want = expected(harmed(rows))
    nothing = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    for r in got:
        assert tuple(r)[1:] == want.get(r.conv_id, nothing), r.conv_id


def test_repaired_rows(spark):
    rows = in_order([(r[0], r[1], r[2] or " ", r[3] or " ") for r in conversations(random.Random(4), 8)])
    made = repair.Repair(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), 2, 1)
    got = {}
    for r in made.repaired().orderBy("key", "place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    want = expected(rows)
    for conv in want:
        said = "\n".join(f"{r}:{t}" for r, t in got.get(conv, []))
        assert hashlib.sha256(said.encode()).hexdigest() == want[conv][-1]


def test_empty(spark):
    assert repair.damage_and_repair(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    rows = repair.damage_and_repair(spark.createDataFrame([(1, gone, "user", "hi.", 0, "")], SCHEMA)).collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
