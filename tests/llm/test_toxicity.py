import gc
import random
import tracemalloc
import weakref
import zlib
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinelake.llm import toxicity
from cinelake.llm.registry import prepare

ORDER = toxicity.ORDER


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "on", "re", "he", "st", "en"]
    bad = ["gruk", "zwix"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(syllables)  # forms that need not have been seen
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus(1500, 1)
    extra = [(10_001, None, None), (10_002, "", None), (10_003, "GRUKan" + " the" * 4000, None), (None, "gruker", None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows + extra], "doc_id bigint, text string, score string").repartition(6)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    return rows, {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}


def test_held_out_accuracy(scored):
    rows, got = scored
    held = [(y, got[i]["predicted"]) for i, _, y in rows if got[i]["held_out"]]
    assert len(held) > 200 and sum(a == b for a, b in held) / len(held) > 0.97


def test_every_row_has_a_score(scored):
    rows, got = scored
    assert len(got) == len(rows) + 4 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[10_002]["predicted"] == 0 and got[10_001]["score"] == got[10_002]["score"]
    assert got[10_003]["predicted"] == 1 and got[None]["held_out"] is False


def test_ratios_match_kneser_ney_by_hand(spark):
    rng = random.Random(2)
    counts = {}
    for _ in range(300):
        gram = "".join(rng.choice("abc") for _ in range(ORDER))
        counts.setdefault(gram, [0, 0])[rng.randint(0, 1)] += rng.randint(1, 3)
    number = lambda g: sum(ord(c) << (8 * i) for i, c in enumerate(reversed(g)))
    d = toxicity.DISCOUNT

    def shared(order):
        if order == 1:
            kinds = {}
            for s in {g[-2:] for g in counts}:
                kinds[s[-1]] = kinds.get(s[-1], 0) + 1
            return {c: n / sum(kinds.values()) for c, n in kinds.items()}
        less, n = shared(order - 1), {}
        for g in {g[-(order + 1) :] for g in counts}:
            n[g[-order:]] = n.get(g[-order:], 0) + 1
        total, kinds = {}, {}
        for s, x in n.items():
            total[s[:-1]], kinds[s[:-1]] = total.get(s[:-1], 0) + x, kinds.get(s[:-1], 0) + 1
        return {s: (x - d + d * kinds[s[:-1]] * less[s[1:]]) / total[s[:-1]] for s, x in n.items()}

    low = shared(ORDER - 1)

    def p(gram, c):
        around = {g: v[c] for g, v in counts.items() if g[:-1] == gram[:-1]}
        total, kinds = sum(around.values()), sum(1 for v in around.values() if v)
        return (max(counts[gram][c] - d, 0) + d * kinds * low[gram[1:]]) / total if total else low[gram[1:]]

    df = spark.createDataFrame([(number(g), v[1], v[0]) for g, v in counts.items()], "gram bigint, toxic bigint, ordinary bigint")
    got = {r["key"]: r["ratio"] for r in toxicity.log_ratios(df).filter("kind = 1").collect()}
    for g in counts:
        assert got[number(g)] == pytest.approx(log(p(g, 1) / p(g, 0)))


def test_grams_of_a_text(spark):
    rows = spark.createDataFrame([("Ab  cd e", 0)], "text string, part int")
    got = {r["gram"]: r["ordinary_a"] for r in rows.mapInArrow(toxicity._count, "gram bigint, " + ", ".join(f"{c} bigint" for c in toxicity.COUNTS)).collect()}
    text = "ab  cd e"
    want = {}
    for i in range(len(text) - ORDER + 1):
        key = int.from_bytes(text[i : i + ORDER].encode(), "big")
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_filter_keeps_rows_as_they_are_and_handles_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", "a"), (1, "some text", "a"), (2, None, "b")], "doc_id bigint, text string, held_out string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    kept = toxicity.without_toxic(docs, labels, threshold=0.6)
    assert kept.columns == docs.columns and kept.count() == 3
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    ids = spark.range(20).withColumnRenamed("id", "doc_id")
    assert [r["h"] for r in ids.select(toxicity.is_held_out().alias("h")).collect()] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(20)]


def test_every_counted_ngram_keeps_its_own_ratio(spark):
    """More n-grams than a fixed table of cells: each answers with its own ratio, an unseen one with its context's, an unknown one with 0."""
    from pyspark.sql import functions as F

    n, base, step = 1_500_000, int.from_bytes(b"!" * (ORDER - 1), "big"), 331
    number = F.col("id") * step + base
    grams = spark.range(n).select(F.lit(1).alias("kind"), (number * 256 + 97).alias("key"), (F.col("id") % 1000).cast("float").alias("ratio"))
    backoffs = spark.range(n).select(F.lit(0).alias("kind"), number.alias("key"), (-(F.col("id") % 1000) - 1).cast("float").alias("ratio"))
    context = lambda i: (i * step + base).to_bytes(ORDER - 1, "big")
    plain = [i for i in range(0, n + 50_000, 97) if all(toxicity._LOWER[c] == c for c in context(i))]
    ids = plain[:: len(plain) // 300]
    assert min(ids) < n <= max(ids)
    docs = spark.createDataFrame([(2 * i + b, context(i) + (b"a", b"b")[b]) for i in ids for b in (0, 1)], "doc_id bigint, text binary").repartition(3)
    got = {r["doc_id"]: r["features"][0] * ORDER for r in toxicity._looked_up(docs, "text", grams.unionByName(backoffs), None, "features").collect()}
    assert got == pytest.approx({2 * i + b: 0.0 if i >= n else (float(i % 1000), -float(i % 1000) - 1)[b] for i in ids for b in (0, 1)})


def test_a_sixth_byte_tells_expressions_apart(spark):
    """Both classes hold the same 5-byte n-grams; only pairs of first and last byte around four others differ."""
    rng = random.Random(4)
    rows = []
    for i in range(1200):
        toxic = rng.randint(0, 1)
        words = ["".join(rng.choice("aeiou") for _ in range(4)) for _ in range(20)]
        for word in ("xbcdfy", "zbcdfw") if toxic else ("xbcdfw", "zbcdfy"):
            words.insert(rng.randrange(len(words)), word)
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")).collect()}
    held = [(y, got[i]["predicted"]) for i, _, y in rows if got[i]["held_out"]]
    assert len(held) > 200 and sum(a == b for a, b in held) / len(held) > 0.95


def test_without_labels_no_document_is_dropped(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (None, "")], "doc_id bigint, text string")
    assert toxicity.without_toxic(docs, spark.createDataFrame([], "doc_id bigint, toxic int")).count() == 3


def test_few_labels_keep_documents(spark):
    """Twelve ordinary labels and one toxic, whichever half the toxic one falls into; one of each; ordinary or toxic ones only."""
    docs = spark.createDataFrame([(i, f"an ordinary text number {i} about the weather") for i in range(13)], "doc_id bigint, text string")
    open_ids = [i for i in range(13) if zlib.crc32(str(i).encode()) % 4 != 2]
    for bad in open_ids[:3]:
        labels = spark.createDataFrame([(i, int(i == bad)) for i in range(13)], "doc_id bigint, toxic int")
        assert toxicity.without_toxic(docs, labels).count() >= 12
    two = spark.createDataFrame([(open_ids[0], 0), (open_ids[1], 1)], "doc_id bigint, toxic int")
    assert toxicity.without_toxic(docs, two).count() == 13
    for only in (0, 1):
        assert toxicity.without_toxic(docs, docs.select("doc_id").withColumn("toxic", F.lit(only))).count() == 13


def test_clashing_columns_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "some text", 0.5, 7, "x"), (1, "some text", 0.5, 7, "x"), (1, "other", None, 8, "y")], "doc_id bigint, text string, __toxicity double, __split int, score string")
    kept = toxicity.without_toxic(docs, spark.createDataFrame([(1, 0), (1, 1)], "doc_id bigint, toxic int"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_questions_and_rows_of_many_blocks_meet(spark, monkeypatch, tmp_path):
    """Files read in several partitions and blocks: every row finds its answers although texts do not travel with the questions."""
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 300)
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choices("abcdef", k=rng.randint(1, 8))) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    grams = {}
    for _, t in rows:
        for i in range(len(t) - ORDER + 1):
            grams[t[i : i + ORDER]] = float(zlib.crc32(t[i : i + ORDER].encode()) % 100)
    table = spark.createDataFrame([(1, int.from_bytes(g.encode(), "big"), v) for g, v in grams.items()], "kind int, key bigint, ratio float")
    got = {r["doc_id"]: r["features"][0] for r in toxicity._looked_up(docs, "text", table, None, "features").collect()}
    want = {i: sum(grams[t[j : j + ORDER]] for j in range(len(t) - ORDER + 1)) / max(len(t), 1) for i, t in rows}
    assert got == pytest.approx(want, rel=1e-5)


def test_shuffle_files_are_released_after_every_step_of_training(spark, monkeypatch):
    steps = []
    for name in ("_table", "_looked_up", "release_shuffles"):
        monkeypatch.setattr(toxicity, name, lambda *args, f=getattr(toxicity, name), name=name: (f(*args), steps.append(name))[0])
    rows = corpus(200, 4)
    toxicity.train(spark.createDataFrame([(i, t, y) for i, t, y in rows], "doc_id bigint, text string, toxic int"))
    release = "release_shuffles"
    assert steps == [release, "_table", release, "_looked_up", release, "_table", release]


def shuffled_rows(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_texts_without_a_label_are_not_shuffled_for_training(spark, monkeypatch):
    """Labels for a tenth of the documents, some twice, some for none of them: the join gets all rows, and few texts are moved for it."""
    monkeypatch.setattr(toxicity, "train", lambda labelled: labelled)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    pairs = [(i, i // 10 % 2) for i in range(0, 6000, 10)] + [(20, 1), (70_000, 1), (None, 1)]
    labels = spark.createDataFrame(pairs, "doc_id bigint, toxic int")
    before = shuffled_rows(spark)
    got = sorted(map(tuple, toxicity.train_on_labels(docs, labels).select("doc_id", "text", "toxic").collect()))
    assert got == sorted((i, f"text {i}", y) for i, y in pairs if i is not None and i < 6000 and zlib.crc32(str(i).encode()) % 4 != 2)
    assert shuffled_rows(spark) - before < 2000


@pytest.mark.parametrize("bits, most", [(16, 2048), (256, 2048), (256, 1)])
def test_marks_keep_every_labelled_document(spark, monkeypatch, bits, most):
    monkeypatch.setattr(toxicity, "BITS_PER_ID", bits)
    monkeypatch.setattr(toxicity, "MOST_BLOCKS", most)
    docs = spark.range(-20_000, 20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = docs.filter("doc_id % 20 = 0").select("doc_id")
    kept = {r["doc_id"] for r in toxicity.likely_labelled(docs, labels).collect()}
    assert kept >= set(range(-20_000, 20_000, 20)) and len(kept) < 8000
    assert toxicity.likely_labelled(docs, labels.select(F.col("doc_id").cast("string"))).count() == 40_000


def test_counts_are_given_up_before_texts_are_dealt_again(spark, monkeypatch):
    made, held = [], []
    monkeypatch.setattr(toxicity, "cut_lineage", lambda df, f=toxicity.cut_lineage: (out := f(df), made.append(weakref.ref(out)))[0])
    monkeypatch.setattr(toxicity, "release_shuffles", lambda spark: held.append((gc.collect(), made[0]() is not None)[1]))
    model = toxicity.train(spark.createDataFrame(corpus(200, 4), "doc_id bigint, text string, toxic int"))
    assert model is not None and held == [True, True, True, False]


def alike_texts(n, size):
    """Texts of `size` bytes that share most n-grams, in batches of one."""
    letters = np.frombuffer(b"abcdefgh", np.uint8)[np.random.default_rng(7).integers(0, 8, size)].tobytes().decode()
    return [f"{i:06d}{letters}" for i in range(n)]


def peak_of(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()


def test_a_block_holds_its_distinct_ngrams_and_little_more():
    texts = alike_texts(100, 200_000)
    batches = [pa.RecordBatch.from_arrays([pa.array([t]), pa.array([0], pa.int32())], ["text", "split"]) for t in texts]
    asked, peak = peak_of(lambda: [r[3] for r in toxicity._rows(toxicity._ask(0, 1, 8)(iter(batches)))])
    got = np.sort(np.concatenate([toxicity._unpacked(p)[0] for p in asked]))
    want = {t[j : j + ORDER] for t in texts[:1] for j in range(len(t) - ORDER + 1)} | {t[j : j + ORDER] for t in texts for j in range(ORDER + 1)}
    assert {int(g).to_bytes(ORDER, "big").decode() for g in got} == want and len(got) == len(want)
    assert peak < 70


def test_counts_leave_in_small_batches_and_add_up(monkeypatch):
    for name, value in (("MERGE_GRAMS", 3000), ("MOST_GRAMS", 9000), ("BATCH_GRAMS", 1000)):
        monkeypatch.setattr(toxicity, name, value, raising=False)
    rows = [(t, i % 4) for i, (_, t, _) in enumerate(corpus(400, 9))] + [("", 0), ("short", 1), (None, 2)]
    batches = [pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows[i : i + 50]], pa.string()), pa.array([g for _, g in rows[i : i + 50]], pa.int32())], ["text", "part"]) for i in range(0, len(rows), 50)]
    made = list(toxicity._count(iter(batches)))
    got = Counter()
    for b in made:
        for gram, *counts in zip(*(c.to_pylist() for c in b.columns)):
            got.update({(gram, c): n for c, n in enumerate(counts) if n})
    want = Counter((int.from_bytes(t[j : j + ORDER].encode(), "big"), g) for t, g in rows if t for j in range(len(t) - ORDER + 1))
    assert got == want and len(made) > 3
    assert max(b.num_rows for b in made) <= 1000


def test_batches_are_bounded_by_bytes(spark):
    """Packed pieces of a megabyte: a task and the JVM beside it hold a few of them, not a thousand."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    prepare(spark)
    got = [r["n"] for r in spark.range(0, 32, 1, 1).select(F.expr("repeat('x', 1000000)").alias("t")).mapInArrow(sizes, "n bigint").collect()]
    assert sum(got) > 32_000_000 and max(got) < 8_000_000
