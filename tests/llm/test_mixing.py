import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cinelake.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Share by weight; whoever is above three times its size stops there and the rest share again."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: [ord(c) for c in n]) + [n for n in sizes if n is None]
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[n] for n in full)
        open_ = [n for n in names if n not in full]
        share = {n: rest * weight[n] / sum(weight[m] for m in open_) for n in open_}
        above = {n for n in open_ if share[n] > 3 * sizes[n]}
        if not above:
            return {n: float(3 * sizes[n]) if n in full else share[n] for n in names}
        full |= above


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    made = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (None, "one two", "empty?"), (4, "é\x0bb\x1cc  d", "z"), (5, "tiny", "tiny")]
    for i in range(400):
        made.append((10 + i, " ".join(rng.choice("abcdefg") * rng.randint(1, 5) for _ in range(rng.randint(0, 300))), rng.choice(["a", "a", "a", "a", "B", "é", "zz", None])))
    return made + made[20:60]


def test_sizes_targets_and_limits(spark, rows):
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, source string, target double").repartition(7)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, again))
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size(text)
    want = targets(sizes)
    source_of = {i: s for i, _, s in rows}
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted((i or 0, size(t)) for i, t, _ in rows)
    taken = defaultdict(int)
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 + 0.02 * want[s], s


def test_mixed_documents_hold_the_taken_words(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    per_source = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size(text)
    want = targets(sizes)
    for s in sizes:
        assert abs(per_source.get(s, 0) - want[s]) <= 2 + 0.02 * want[s], s
    whole = {(i, s): t for i, t, s in rows}
    for r in mixed.collect():
        words, ours = whole[r["doc_id"], r["source"]].encode().split(), iter(whole[r["doc_id"], r["source"]].encode().split())
        assert all(w in ours for w in r["text"].encode().split()) and len(words)


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1001])
def test_permutation_is_one_to_one(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("key"), F.lit(3)).alias("p")).collect()
    assert sorted(r["p"] for r in got) == list(range(n))


def test_targets_stop_at_three_times_the_size(spark):
    sizes = {"a": 10, "b": 1, "c": 1000, None: 0, "d": 2}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = targets(sizes)
    assert all(got[s] == pytest.approx(want[s]) for s in sizes)


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


def test_columns_of_any_name_stay_and_slots_are_dealt(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "a b c d e f", 9, "p", i) for i in range(60)], "doc_id bigint, source string, text string, __key int, __plan string, __pass bigint")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {(r["__key"], r["__plan"]) for r in mixed.collect()} == {(9, "p")}
    pieces = spark.createDataFrame([(1, 50_000)], "k int, n bigint")
    sizes = mixing._expanded(pieces, F.col("n"), "at", 9).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 4 and sum(r["count"] for r in sizes) == 50_000


def test_blocks_are_merged_and_not_broadcast(spark, rows):
    """Slots and blocks are laid out from a few rows, so Spark takes them for small at every size."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for mixed, joins in ((mixing.mix(docs), 2), (mixing.mixed_documents(docs), 3)):
        mixed.collect()
        plan = mixed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len(re.findall(r"SortMergeJoin \[(?:block|key|__key)#", plan)) == joins
        assert not re.search(r"BroadcastHashJoin \[(?:block|key|__key)#", plan)
