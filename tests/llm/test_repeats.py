import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cinelake.llm import repeats, substring_dedup, suffix_dedup

WORDS = ["a", "b", "c", "dd", "é", "x\x1cy", " "]


def expected(texts, sequence, width, joint):
    units = [sequence(t or "") for t in texts]
    windows = Counter(s[p : p + width] for s in units for p in range(len(s) - width + 1))
    out = []
    for s in units:
        gone = [False] * len(s)
        for p in range(len(s) - width + 1):
            if windows[s[p : p + width]] > 1:
                gone[p : p + width] = [True] * width
        kept = [u for u, g in zip(s, gone) if not g]
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(s), sum(gone), spans, hashlib.sha256(joint(kept)).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    line = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(6)]
    made = [None, "", " \n", "a", "a " * 500, "b " * 300, "a b " * 200]
    for _ in range(120):
        parts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))) if rng.random() < 0.6 else rng.choice(line) for _ in range(rng.randint(1, 8))]
        made.append(rng.choice([" ", "\n", "\t  "]).join(parts))
    return made + made[7:40] + [made[10]] * 30


@pytest.mark.parametrize("most", [200, 2])
def test_words_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_IN_CLASS", most)  # 2: nearly every class is split into windows
    given = texts(1)
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id bigint, text string").repartition(8)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.remove_repeated_passages(docs, 9, 3).collect()}
    want = expected(given, lambda t: tuple(t.encode().split()), 9, b" ".join)
    assert [got[i] for i in range(len(given))] == want


@pytest.mark.parametrize("most", [200, 2])
def test_bytes_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_IN_CLASS", most)
    given = texts(2)
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id bigint, text string").repartition(8)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeated_bytes(docs, 20, 5).collect()}
    want = expected(given, lambda t: t.encode(), 20, bytes)
    assert [got[i] for i in range(len(given))] == want


def test_resolvers_agree_with_sets():
    rng = random.Random(5)
    for _ in range(30):
        keys, offsets, contents = [], [], []
        for key in range(rng.randint(1, 5)):
            for content in {bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 20))) for _ in range(rng.randint(1, 6))}:
                keys.append(key), offsets.append(rng.randint(0, 8)), contents.append(content)
        windows = Counter((k, o + p, c[p : p + 8]) for k, o, c in zip(keys, (-x for x in offsets), contents) for p in range(len(c) - 7))
        want = [[p for p in range(len(c) - 7) if windows[k, p - o, c[p : p + 8]] > 1] for k, o, c in zip(keys, offsets, contents)]
        assert [list(w) for w in suffix_dedup.resolve(np.array(keys), np.array(offsets), contents, 8)] == want


def test_automaton_finds_what_other_sequences_hold():
    a, b = list("abcabx"), list("zcabxq")
    automaton = substring_dedup.SuffixAutomaton()
    automaton.add(a), automaton.add(b)
    shared = {s for s, state in automaton.places(a, 3)} & {0, 1, 2, 3}
    assert shared == {0, 1, 2, 3}
    states_a, states_b = ({s: at for s, at in automaton.places(x, 3)} for x in (a, b))
    assert states_a[2] == states_b[1] and states_a[3] == states_b[2]


def test_empty_table_repeated_rows_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert substring_dedup.remove_repeated_passages(empty).count() == 0
    long = " ".join(str(i) for i in range(40))
    docs = spark.createDataFrame([(1, long, "k"), (1, long, "k"), (None, long + " z", "n"), (2, "short", None)], "doc_id bigint, text string, key string")
    got = sorted(((r["doc_id"] or 0), r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeated_passages(docs).collect())
    assert got == [(0, 41, 40), (1, 40, 40), (1, 40, 40), (2, 1, 0)]
