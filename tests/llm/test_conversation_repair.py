"""Repair of conversations against exhaustive and plain versions."""

import hashlib
import itertools
import random
import re
from zlib import crc32

import pytest

from cinelake.llm import conversation_repair as cr
from cinelake.llm.queries import op13_conversation_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string"
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip("\t\n\x0b\x0c\r ")
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif bare[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append(None)
        seen.add((role, text))
    return out


def exhaustive(rows):
    """All edits of every row with up to two inserts in every gap."""
    found = faults(rows)
    options = []
    for (role, text), fault in zip(rows, found):
        extra = fault == "truncated"
        edits = [("D", 3, [])]
        if fault not in ("blank", "duplicate"):
            edits.append(("K", extra, [(role, text)]))
            edits += [("R", 2 + extra, [(x, text)]) for x in ("user", "assistant")]
        options.append(edits)
    gap = [("I" * n, 2 * n, [(r, "") for r in roles]) for n in range(3) for roles in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    lists = [gap]
    for edits in options:
        lists += [edits, gap]
    for choice in itertools.product(*lists):
        lines = [x for c in choice for x in c[2]]
        if all(r for r, _ in lines) and GRAMMAR.fullmatch("".join(r[0] for r, _ in lines)):
            key = (sum(c[1] for c in choice), "".join(c[0] for c in choice))
            if best is None or key < best[0]:
                best = (key, lines)
    return best


def plain(rows):
    """The same by a table of whole strings."""
    steps = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    best = {0: (0, "", ())}

    def closed(best):
        todo = dict(best)
        for _ in range(3):
            for state, (cost, audit, lines) in list(todo.items()):
                for x, role in (("u", "user"), ("a", "assistant")):
                    if x in steps[state]:
                        new = (cost + 2, audit + "I", lines + ((role, ""),))
                        old = todo.get(steps[state][x])
                        if old is None or new[:2] < old[:2]:
                            todo[steps[state][x]] = new
        return todo

    for (role, text), fault in zip(rows, faults(rows)):
        reached = {}
        for state, (cost, audit, lines) in closed(best).items():
            edits = [(3, "D", (), state)]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role[:1] in steps[state]:
                    edits.append((extra, "K", ((role, text),), steps[state][role[:1]]))
                edits += [(2 + extra, "R", ((r, text),), steps[state][r[0]]) for r in ("user", "assistant") if r[0] in steps[state]]
            for c, letter, more, after in edits:
                new = (cost + c, audit + letter, lines + more)
                if after not in reached or new[:2] < reached[after][:2]:
                    reached[after] = new
        best = reached
    return min((v for k, v in closed(best).items() if k in (0, 3)), key=lambda v: v[:2])


def expected(rows):
    """The query's columns by conversation, from plain lists."""
    out = []
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role if role is not None else " ", text if text is not None else " "))
    for conv, turns in convs.items():
        damaged = []
        for turn, role, text in turns:
            fate = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if fate == 0:
                continue
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            damaged += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        lines = [r[1:] for r in damaged]
        found = faults(lines)
        known = {r[0] for r in damaged if r[0] is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        cost, audit, repaired = plain(lines)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def random_rows(rng, conv, n):
    texts = ["One.", "Two!", "Three", "four?", " ", "", "Five. \n", "six \x0b", None, "längere Worte.", "\xa0"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "agent", "User"]
    return [(conv, rng.choice([i, i, i, i + 1, None]), rng.choice(roles), rng.choice(texts)) for i in range(n)]


def test_solver_against_every_edit():
    rng = random.Random(3)
    texts = ["A.", "B.", "C", "", "D.", "e"]
    for _ in range(150):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(texts)) for _ in range(rng.randint(0, 3))]
        (cost, audit), lines = exhaustive(rows)
        assert plain(rows)[:2] == (cost, audit)
        assert list(plain(rows)[2]) == lines


def codes_of(rows):
    kinds = {None: 0, "blank": 1, "duplicate": 2, "truncated": 3}
    return "".join(chr(cr.CODE + 4 * ("sua".find(r[:1]) if r[:1] in ("s", "u", "a") else 3) + kinds[f]) for (r, _), f in zip(rows, faults(rows)))


@pytest.mark.parametrize("width", [1, 2, 7, 10_000])
def test_runs_joined_like_the_whole(width):
    rng = random.Random(width)
    for n in (0, 1, 5, 40, 200):
        rows = [(rng.choice(["user", "assistant", "user", "system", "x"]), rng.choice(["A.", "B", "C.", ""]) + rng.choice(["", "1.", "2", "3!"])) for _ in range(n)]
        codes = codes_of(rows)
        runs = [[cr.solve(codes[i : i + width], p) for p in range(4)] for i in range(0, n, width)]
        cost, parts = cr.join_runs(runs)
        want = plain(rows)
        assert (cost, "".join(p[1] for p in parts)) == want[:2]


def test_colliding_hashes_are_told_apart(monkeypatch):
    rows = [("user", f"{i}." if i % 3 else f"{i}") for i in range(60)]
    monkeypatch.setattr(cr, "_PRIME", 7)
    found = cr._solve(codes_of(rows), 0)
    monkeypatch.undo()
    assert found == cr._solve(codes_of(rows), 0)
    audits = cr.Audits()
    a = audits.add(audits.add(0, "D"), "K")
    assert audits.add(audits.add(0, "D"), "K") == a and audits.string(a) == "DK"


@pytest.mark.parametrize("rows_per_segment, segment", [(1_000_000, 4096), (40, 16)])
def test_query_against_plain_lists(spark, rows_per_segment, segment):
    rng = random.Random(9)
    rows = [r for c in range(60) for r in random_rows(rng, c, rng.randint(1, 9))]
    rows += random_rows(rng, None, 7) + random_rows(rng, 500, 150) + [(600, t, "user", "All day long.") for t in range(90)]
    rows += [(700, 0, "user", "x" * 300_000), (700, 1, "assistant", "y. " * 100_000)] + [(c, 3, "user", "one.") for c in range(800, 840)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA).repartition(7)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in cr.repair_damaged(docs, rows_per_segment, segment).collect()), key=repr)
    assert got == expected(rows)
    assert any(r[-2] == "" for r in got)


def test_repaired_turns_and_no_rows(spark):
    rows = [(1, 0, "user", "Hello.", ""), (1, 1, "user", "Again.", ""), (1, 2, "user", "Again.", ""), (2, 0, "assistant", "", "")]
    repair = cr.Repair(spark.createDataFrame(rows, SCHEMA))
    turns = sorted((r.conv_id, r.place, r.role, r.text) for r in repair.turns().collect())
    assert turns == [(1, 1, "user", "Hello."), (1, 2, "assistant", "Again.")]
    assert {(r.conv_id, r.audit, r.cost) for r in repair.audits().collect()} == {(1, "KRD", 5), (2, "D", 3)}
    assert cr.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []


def test_given_conversations(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in op13_conversation_repair(spark, folder).collect()), key=repr)
    assert got == expected(rows)
