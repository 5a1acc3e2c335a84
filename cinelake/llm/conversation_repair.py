"""Faults of conversations and their cheapest repair, with an audit of every edit.

A repaired conversation is empty or has the role initials `s?(ua)+`. Edits in order: Keep, Rerole (to user or assistant), Delete and Insert
(an empty turn of user or assistant, anywhere); the audit is the string of their initials. Among audits of least cost the least by ASCII is
taken. Two audits of equal cost over the same rows are never one the start of the other, so the least audit of a run of rows between two
grammar states stays least whatever follows: runs of `SEGMENT` rows are solved apart, for every state they may begin in, and joined in order.
Texts travel once, when the edits are applied; everything before works on one letter a row.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cinelake.llm.texts import kept_in_worker
from cinelake.operators.skew import ROWS_PER_SALT, range_segments, row_number_across, salted_lookup
from cinelake.session import cut_lineage

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
#: Rows solved together.
SEGMENT = 4096
#: Short conversations whose solution a worker remembers.
MEMO = 50_000
INITIALS = "sua"
LEGAL = ("su", "ua", "au")
CODE = ord("A")
_OK, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
#: Where a role leads from: nothing yet, after system, after user, after assistant.
_STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ENDS = (0, 3)
#: Inserts that lead from one state to another, where any do.
_INSERTS = {(0, 2): 1, (0, 3): 2, (1, 2): 1, (1, 3): 2, (2, 3): 1, (3, 2): 1}
_SPACES = "\t\n\x0b\x0c\r "
_PRIME, _RADIX = (1 << 61) - 1, 0x1F3D5B79A2C4E687


class Audits:
    """Strings of edits as linked nodes, one letter each; equal strings are the same node.

    A node is found by the rolling hash of its string, and what is found is verified by parent and letter, so that a collision gets a node
    of its own. Ancestors at distances 1, 2, 4, ... lead to the longest common prefix of two strings.
    """

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[]]
        self._known: dict[int, list[int]] = {}

    def add(self, node: int, letter: str) -> int:
        value = (self.hash[node] * _RADIX + ord(letter)) % _PRIME
        same = self._known.setdefault(value, [])
        for other in same:
            if self.letter[other] == letter and self.up[other][0] == node:
                return other
        up = [node]
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        new = len(self.letter)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append(value)
        self.up.append(up)
        same.append(new)
        return new

    def _above(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            steps = self.up[node]
            k = min((self.depth[node] - depth).bit_length(), len(steps)) - 1
            node = steps[k]
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether the string of `a` comes before that of `b`, by the letter after their longest common prefix."""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self._above(a, depth), self._above(b, depth)
        if x == y:
            return self.depth[a] < self.depth[b]
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]) and self.up[x][k] != self.up[y][k]:
                x, y = self.up[x][k], self.up[y][k]
        return self.letter[x] < self.letter[y]

    def string(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def _edits(code: str) -> list[list[tuple[int, str, int]]]:
    """By state before the row: (cost, letter, state after it) of every edit of a row with this code."""
    initial, fault = divmod(ord(code) - CODE, 4)
    extra = TRUNCATED if fault == _TRUNCATED else 0
    out = []
    for state, steps in enumerate(_STEPS):
        edits = [(DELETE, "D", state)]
        if fault not in (_BLANK, _DUPLICATE):
            if initial < 3 and INITIALS[initial] in steps:
                edits.append((KEEP + extra, "K", steps[INITIALS[initial]]))
            edits.extend((REROLE + extra, "R", steps[x]) for x in "ua" if x in steps)
        out.append(edits)
    return out


_MOVES = {}
for _code in map(chr, range(CODE, CODE + 16)):
    _by_state = _edits(_code)
    _MOVES[_code] = [
        [(INSERT * n + cost, "I" * n + letter, after) for at, n in [(state, 0), *[(q, n) for (p, q), n in _INSERTS.items() if p == state]] for cost, letter, after in _by_state[at]]
        for state in range(4)
    ]


def solve(codes: str, entry: int = 0) -> list[tuple[int, str] | None]:
    """By state after the rows: the least (cost, audit) that leads there from `entry`."""
    if len(codes) > 32:
        return _solve(codes, entry)
    known = kept_in_worker("short_audits", dict)
    if (codes, entry) not in known:
        if len(known) >= MEMO:
            known.clear()
        known[codes, entry] = _solve(codes, entry)
    return known[codes, entry]


def _solve(codes: str, entry: int) -> list[tuple[int, str] | None]:
    audits = Audits()
    best: list[tuple[int, int] | None] = [None] * 4
    best[entry] = (0, 0)
    for code in codes:
        moves = _MOVES[code]
        reached: list[tuple[int, int] | None] = [None] * 4
        for state, have in enumerate(best):
            if have is None:
                continue
            for cost, letters, after in moves[state]:
                total, old = have[0] + cost, reached[after]
                if old is not None and total > old[0]:
                    continue
                node = have[1]
                for letter in letters:
                    node = audits.add(node, letter)
                if old is None or total < old[0] or audits.less(node, old[1]):
                    reached[after] = (total, node)
        best = reached
    return [None if x is None else (x[0], audits.string(x[1])) for x in best]


def _before(a, b) -> bool:
    """Whether one chain of runs gives a lesser audit than another of the same length; chains are (runs before, letters)."""
    left, right = [], []
    while a is not b:
        left.append(a[1])
        right.append(b[1])
        a, b = a[0], b[0]
    x, y = "", ""
    while left and right:
        x, y = x + left.pop(), y + right.pop()
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]
    return len(x) < len(y)


def join_runs(runs: list[list[list[tuple[int, str] | None]]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost and (state, letters) of each run of one conversation, from `solve` of every run by every state it may begin in."""
    best: list = [(0, None)] + [None] * 3
    for solved in runs:
        reached: list = [None] * 4
        for state, have in enumerate(best):
            if have is None:
                continue
            for after, found in enumerate(solved[state]):
                if found is None:
                    continue
                total, chain = have[0] + found[0], (have[1], found[1], state)
                old = reached[after]
                if old is None or total < old[0] or (total == old[0] and _before(chain, old[1])):
                    reached[after] = (total, chain)
        best = reached
    last = None
    for state, have in enumerate(best):
        for end in _ENDS:
            n = 0 if end == state else _INSERTS.get((state, end))
            if have is None or n is None:
                continue
            total, chain = have[0] + INSERT * n, (have[1], "I" * n, state)
            if last is None or total < last[0] or (total == last[0] and _before(chain, last[1])):
                last = (total, chain)
    parts = []
    chain = last[1]
    while chain is not None:
        parts.append((chain[2], chain[1]))
        chain = chain[0]
    parts.reverse()
    ending = parts.pop()[1]
    if parts:
        parts[-1] = (parts[-1][0], parts[-1][1] + ending)
    return last[0], parts


# -- faults ------------------------------------------------------------------------------------------------------------------------


def _keyed(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, text): nulls of role and text are one space, the conversation is a string that a null has too."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        text.alias("text"),
    )


_ORDER = ["turn", "role", "digest"]


def _coded(keyed: DataFrame, rows_per_segment: int) -> DataFrame:
    """(conv, place, turn, role, digest, code): a letter for the role's initial and the row's first fault."""
    last = F.substring(F.rtrim("text", F.lit(_SPACES)), -1, 1)
    initial = F.lit(3)
    for i, x in enumerate(INITIALS):
        initial = F.when(F.startswith("role", F.lit(x)), i).otherwise(initial)
    fault = F.when(last == "", _BLANK).when(last.isin(".", "!", "?"), _OK).otherwise(_TRUNCATED)
    light = keyed.select("conv", *_ORDER, initial.alias("initial"), fault.alias("fault"))
    placed = row_number_across(range_segments(light, ["conv"], _ORDER, "__segment", rows_per_segment), ["conv"], "__segment", _ORDER, "place")
    placed = cut_lineage(placed.drop("__segment"))
    same = placed.groupBy("conv", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n_same")).filter("n_same > 1")
    seen = salted_lookup(placed, same, ["conv", "digest"], "n_same", "left", rows_per_segment)
    fault = F.when((F.col("fault") != _BLANK) & (F.col("place") > F.col("first")), _DUPLICATE).otherwise(F.col("fault"))
    return seen.select("conv", "place", *_ORDER, F.char(F.lit(CODE) + 4 * F.col("initial") + fault).alias("code"))


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs, audits = [], []
        for run, codes in zip(batch.column("run").to_pylist(), batch.column("codes").to_pylist()):
            found = [solve(codes, entry) if entry == 0 or run > 0 else [None] * 4 for entry in range(4)]
            costs.append([None if x is None else x[0] for row in found for x in row])
            audits.append([None if x is None else x[1] for row in found for x in row])
        columns = {name: batch.column(name) for name in batch.schema.names}
        yield pa.RecordBatch.from_pydict({**columns, "costs": pa.array(costs, pa.list_(pa.int64())), "audits": pa.array(audits, pa.list_(pa.string()))})


_RUN = "conv string, run bigint, codes string, turn bigint, role string, digest binary"
_PLAN = _RUN.replace("codes string", "n_rows bigint, state int, letters string") + ", cost bigint, audit string, blank bigint, duplicate bigint, truncated bigint, illegal bigint"


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of whole conversations in order in, edits of each run out; a conversation's totals stand on its first run."""
    names = [part.split()[0] for part in _PLAN.split(", ")]

    def plan(runs: list[dict]) -> list[dict]:
        table = [[[None if c is None else (c, a) for c, a in zip(r["costs"][4 * p : 4 * p + 4], r["audits"][4 * p : 4 * p + 4])] for p in range(4)] for r in runs]
        cost, parts = join_runs(table)
        faults, illegal, before = [0] * 4, 0, None
        for r in runs:
            for code in r["codes"]:
                initial, fault = divmod(ord(code) - CODE, 4)
                faults[fault] += 1
                now = INITIALS[initial] if initial < 3 else "?"
                illegal += before is not None and before + now not in LEGAL
                before = now
        totals = {
            "cost": cost, "audit": "".join(p[1] for p in parts), "blank": faults[_BLANK], "duplicate": faults[_DUPLICATE], "truncated": faults[_TRUNCATED], "illegal": illegal,
        }
        return [
            {**{c: r[c] for c in ("conv", "run", "turn", "role", "digest")}, "n_rows": len(r["codes"]), "state": state, "letters": letters, **(totals if i == 0 else {})}
            for i, (r, (state, letters)) in enumerate(zip(runs, parts))
        ]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: [r.get(c) for r in rows] for c in names}, schema=schema)

    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(part.split()[0], types[part.split()[1]]) for part in _PLAN.split(", ")])
    held: list[dict] = []
    for batch in batches:
        out: list[dict] = []
        for row in batch.to_pylist():
            if held and held[0]["conv"] != row["conv"]:
                out.extend(plan(held))
                held = []
            held.append(row)
        if out:
            yield batch_of(out)
    if held:
        yield batch_of(plan(held))


def _plans(keyed: DataFrame, rows_per_segment: int, segment: int) -> DataFrame:
    coded = _coded(keyed, rows_per_segment)
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]), "")
    runs = coded.groupBy("conv", F.floor((F.col("place") - 1) / segment).alias("run")).agg(letters.alias("codes"), F.min(F.struct(*_ORDER)).alias("at"))
    runs = runs.select("conv", "run", "codes", "at.*").mapInArrow(_solved, _RUN + ", costs array<bigint>, audits array<string>")
    return cut_lineage(runs.repartition("conv").sortWithinPartitions("conv", "run").mapInArrow(_planned, _PLAN))


# -- repair ------------------------------------------------------------------------------------------------------------------------

_ROLES = {2: "user", 3: "assistant"}
_TURN = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plans and rows of conversations in order in, repaired rows out."""
    conv, state, place = None, 0, 0
    plans: deque = deque()
    for batch in batches:
        out = {"conv": [], "place": [], "role": [], "text": []}

        def emit(role: str, text: str) -> None:
            nonlocal place
            place += 1
            for name, value in zip(out, (conv, place, role, text)):
                out[name].append(value)

        def inserts() -> None:
            nonlocal state
            plan = plans[0]
            while plan[1] < len(plan[0]) and plan[0][plan[1]] == "I":
                plan[1] += 1
                state = 3 if state == 2 else 2
                emit(_ROLES[state], "")

        for row in batch.to_pylist():
            if row["conv"] != conv:
                conv, state, place = row["conv"], 0, 0
                plans.clear()
            if row["letters"] is not None:
                plans.append([row["letters"], 0, row["n_rows"]])
                continue
            inserts()
            plan = plans[0]
            letter = plan[0][plan[1]]
            plan[1] += 1
            plan[2] -= 1
            if letter == "K":
                state = _STEPS[state][row["role"][0]]
                emit(row["role"], row["text"])
            elif letter == "R":
                state = 3 if state == 2 else 2
                emit(_ROLES[state], row["text"])
            if plan[2] == 0:
                inserts()
                plans.popleft()
        yield pa.RecordBatch.from_pydict(out, schema=_TURN)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per conversation of its `role:text` lines, as they come."""
    conv, digest = None, None
    for batch in batches:
        done, values = [], []
        for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "role", "text"))):
            if c != conv:
                if digest is not None:
                    done.append(conv)
                    values.append(digest.hexdigest())
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_pydict({"conv": pa.array(done, pa.string()), "repaired_sha256": pa.array(values, pa.string())})
    if digest is not None:
        yield pa.RecordBatch.from_pydict({"conv": [conv], "repaired_sha256": [digest.hexdigest()]})


class Repair:
    """The faults and the cheapest repair of `rows` (conv_id, turn, role, text).

    Rows of a conversation are taken by turn, null first, then role and a digest of role and text; a null role or text is one space, rows
    with a null conv_id are a conversation. A row's first fault counts: blank, duplicate (role and text seen earlier in the conversation),
    truncated (last character that is no space is none of `.!?`). A role whose first letter is none of s, u, a (an empty role too) cannot be
    kept. Repeated rows are duplicates; other columns are ignored; no rows give no rows.

    A conversation of any length is placed and solved in parts; its audit is one string, and its repaired rows and their digest, which are
    in order, are streamed through one task.
    """

    def __init__(self, rows: DataFrame, rows_per_segment: int = ROWS_PER_SALT, segment: int = SEGMENT):
        self._keyed = _keyed(rows)
        self._plans = _plans(self._keyed, rows_per_segment, segment)

    def audits(self) -> DataFrame:
        """(conv_id, blank, duplicate, truncated, illegal, cost, audit), one row per conversation."""
        return self._plans.filter("run = 0").select(_conv_id(), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def _repaired(self) -> DataFrame:
        none = F.lit(None)
        plans = self._plans.select("conv", *_ORDER, F.lit(0).alias("kind"), "run", "n_rows", "letters", none.cast("string").alias("text"))
        rows = self._keyed.select(
            "conv", *_ORDER, F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("run"), none.cast("bigint").alias("n_rows"), none.cast("string").alias("letters"), "text"
        )
        both = plans.union(rows).repartition("conv").sortWithinPartitions("conv", *_ORDER, "kind", "run")
        return both.mapInArrow(_applied, "conv string, place bigint, role string, text string")

    def turns(self) -> DataFrame:
        """(conv_id, place, role, text): the repaired conversations, place counting from 1."""
        return self._repaired().select(_conv_id(), "place", "role", "text")

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256) of the `role:text` lines of every conversation that keeps any."""
        return self._repaired().mapInArrow(_digested, "conv string, repaired_sha256 string").select(_conv_id(), "repaired_sha256")


def _conv_id():
    return F.expr("try_cast(conv as bigint)").alias("conv_id")


# -- the query's damage ------------------------------------------------------------------------------------------------------------


def _fate():
    name = F.concat(*[F.coalesce(x, F.lit(" ")) for x in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))])
    return F.crc32(name.cast("binary")) % 20


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults that a hash of conversation and turn deals out; null roles and texts are one space."""
    fate = _fate()
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.filter(fate != 0).select(
        "conv_id", "turn", F.when(fate == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("__copy"),
    )
    return rows.drop("__copy")


def repair_damaged(conversations: DataFrame, rows_per_segment: int = ROWS_PER_SALT, segment: int = SEGMENT) -> DataFrame:
    """One row for every conversation of `conversations`: its damaged rows' gaps and faults, and the audit and digest of their repair.

    A null conv_id or turn is one space in the hash. A conversation that lost all rows has zeros, an empty audit and the hash of nothing.
    """
    repair = Repair(damaged(conversations), rows_per_segment, segment)
    left = F.when(_fate() != 0, F.col("turn"))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    turns = conversations.select("conv_id", left.alias("turn")).distinct()
    base = turns.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"))
    found = base.alias("b").join(repair.audits().alias("a"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left")
    found = found.join(repair.digests().alias("d"), F.col("d.conv_id").eqNullSafe(F.col("b.conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(
        "b.conv_id", "gaps", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
