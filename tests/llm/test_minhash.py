import random
from collections import Counter

import numpy as np
import pytest

from cinelake.llm import minhash


def bag(text):
    words = (text or "").encode().split()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def classes(texts):
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [bag(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or similarity(bags[i], bags[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("pqrst") * 3
    return words


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    made = [None, "", "", "a b c d", "a b c d", "a b c d e", "x y " * 200, "x y " * 150, "x y " * 240]
    for _ in range(12):
        base = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(5, 400))]
        made.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            made.append(" ".join(edited(rng, base, rng.randint(0, 1 + len(base) // 30))))
    return made


def test_classes_match_all_pairs(spark, texts, monkeypatch):
    monkeypatch.setattr(minhash, "_PER_SALT", 2)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, class bigint").repartition(6)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)


@pytest.mark.parametrize("block, shingles", [(4, 1 << 20), (1024, 500)])
def test_links_that_leaders_miss_are_found(spark, texts, monkeypatch, block, shingles):
    monkeypatch.setattr(minhash, "LEADER_ROUNDS", 0)
    monkeypatch.setattr(minhash, "_BLOCK", block)
    monkeypatch.setattr(minhash, "_BLOCK_SHINGLES", shingles)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)


@pytest.mark.parametrize("rare", [1, 3, 8])
def test_overlaps_of_a_block_are_exact(monkeypatch, rare):
    monkeypatch.setattr(minhash, "_RARE", rare)
    monkeypatch.setattr(minhash, "_COLUMNS", 7)
    rng = random.Random(9)
    bags = [Counter(rng.choices(range(1, 60), k=rng.randint(1, 80))) for _ in range(20)]
    held = [(np.array(sorted(b), np.uint64), np.array([b[k] for k in sorted(b)])) for b in bags]
    both = minhash._common(held)
    assert all(both[i, j] == sum((bags[i] & bags[j]).values()) for i in range(20) for j in range(20) if i != j)


def test_a_block_sends_rows_and_a_forest_for_many_near_misses(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join("x" if k in (i % 50, i * 7 % 50 + 50) else w for k, w in enumerate(words)) + f" t{i}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert [got[i].class_id for i in range(120)] == classes([t for _, t in rows])
    assert sum(r.n_links for r in got.values()) < 40 * len(rows)


def test_slots_agree_as_often_as_the_bags_overlap():
    rng = np.random.default_rng(3)
    agreed, expected = [], []
    for _ in range(60):
        hashes = np.sort(rng.integers(0, 2**63, 80).astype(np.uint64))
        a, b = rng.integers(1, 12, 80), rng.integers(1, 12, 80)
        s = minhash.signatures(np.repeat([0, 1], 80), np.concatenate([hashes, hashes]), np.concatenate([a, b]), 2)
        agreed.append((s[0] == s[1]).mean())
        expected.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(agreed) - np.mean(expected)) < 0.02


def test_one_row_of_each_class_stays(spark):
    text = " ".join(str(i) for i in range(30))
    rows = [(3, text, "a"), (2, text + " 30", "b"), (2, text + " 30", "b"), (None, "alone", "c"), (None, "alone", "c"), (7, "", "d"), (8, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, class string")
    kept = sorted((r["doc_id"] or -1, r["class"]) for r in minhash.keep_one_of_each(docs).collect())
    assert kept == [(-1, "c"), (2, "b"), (7, "d")]
    assert minhash.keep_one_of_each(docs).columns == docs.columns
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_null_ids_are_linked_and_repeated_rows_count_once(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(None, text), (None, text + " more"), (None, text + " more"), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (6, "a b c d e f g h i"), (6, "a b c d e f g h i")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = minhash.keep_one_of_each(docs).collect()
    assert len(kept) == 2 and sorted(r.doc_id or 0 for r in kept) == [0, 5]
    links = {(r.doc_id, r.class_id, r.n_links) for r in minhash.near_duplicates(docs).collect()}
    assert links == {(None, None, 1), (5, 5, 1), (6, 5, 1)}


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", 7, "n", True)], "doc_id bigint, text string, __id int, __node string, __kept boolean")
    assert [tuple(r) for r in minhash.keep_one_of_each(docs).collect()] == [(1, "one two three four five six", 7, "n", True)]
    assert minhash.keep_one_of_each(docs).columns == docs.columns
