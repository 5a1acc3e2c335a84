"""The trie of conversations against a plain dictionary of prefixes."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from cinelake.llm import conversation_trie as ct
from cinelake.llm.queries import op11_conversation_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = (turn is not None, turn or 0, role.encode(), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())
            convs.setdefault(conv, []).append((key, (role, text)))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}
    rebuilt = {}
    for c in own:
        h = crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p, members in nodes.items():
        own_saved = (len(members) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saved
            leaves[p[:d]] += p not in children
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(p))))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), len(children.get(p, ())), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_minima_against_scans():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        values = rng.integers(0, 5, n)
        m = ct.Minima(values)
        starts = rng.integers(0, n, 50)
        ends = np.array([rng.integers(s + 1, n + 1) for s in starts])
        depth = rng.integers(0, 6, 50)
        assert m.of(starts, ends).tolist() == [values[a:b].min() for a, b in zip(starts, ends)]
        assert m.right(starts, depth).tolist() == [next((j for j in range(a, n) if values[j] < d), n) for a, d in zip(starts, depth)]
        assert m.left(ends, depth).tolist() == [next((j for j in reversed(range(b)) if values[j] < d), -1) for b, d in zip(ends, depth)]


def conversations(rng):
    """Beginnings that many share, copies, long ones that part late, gaps, ties and nulls."""
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            rows.append((c * 7 - 50, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc", "é漢"])))
    for c in range(300, 390):
        rows += [(c, t, "user", "same") for t in range(7)]
    for c in range(400, 404):
        rows += [(c, t, "user" if t % 2 else "assistant", f"turn {t if t < 50 + c % 4 else t + c}") for t in range(70)]
    rows += [(405, t, "user", "alone") for t in range(40)] + [(406, t, "user", "alone") for t in range(16)] + [(407, t, "user", "alone") for t in range(9)]
    rows += [(700, None, None, None), (700, None, "user", ""), (700, 3, "user", "x"), (700, 3, "user", "x"), (701, 0, "user", "z" * 200_000), (None, 0, "user", "nobody")]
    rows += [(1001, 0, "user", "only"), (1102, 0, "user", "only"), (1203, 0, "user", "only"), (1304, 0, "user", "only")]
    return rows


@pytest.mark.parametrize("block, per_task, per_segment", [(512, 1_000_000, 1_000_000), (8, 40, 30), (4, 1_000_000, 1_000_000), (512, 25, 1_000_000)])
def test_like_a_dictionary_of_prefixes(spark, block, per_task, per_segment):
    rows = conversations(random.Random(4))
    table = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA).repartition(6)
    turns, members = ct.rebuilt(ct.turn_digests(table, per_segment), rows_per_segment=per_segment)
    assert found(ct.prefix_trie(turns, members, block, per_task, per_segment)) == expected(rows)


def test_no_rows_and_no_turns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ct.prefix_trie(*ct.rebuilt(ct.turn_digests(none))).collect() == []
    idle = next(c for c in range(1, 100) if crc32(str(c).encode()) % 6 > 1)
    rows = [(idle, 0, "user", "dropped")]
    got = found(ct.prefix_trie(*ct.rebuilt(ct.turn_digests(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)))))
    assert got == expected(rows) and got[0][:4] == (idle, 0, None, 1)


def test_given_conversations(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    assert found(op11_conversation_trie(spark, folder)) == expected(rows)
