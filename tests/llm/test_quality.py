import random
import re
from collections import Counter

from cinelake.llm import quality


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), failed


def test_counts_match_a_plain_reading(spark):
    rng = random.Random(1)
    given = [None, "", "\n\n", " a", "a\n a\na\n", "é " * 50, "x" * 3000, "w " * 40_000]
    given += ["".join(rng.choice(["a ", "b ", "c\n", "é#", "\r\n", "  ", "d\x1c", "dd "]) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(given)], "doc_id bigint, text string, kept string").repartition(5)
    got = {r["doc_id"]: r for r in quality.repetition_report(docs).collect()}
    for i, t in enumerate(given):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(t), t
        assert not (r["kept"] and r["base_failed"])


def test_clean_text_stays_and_repetition_goes(spark):
    rng = random.Random(2)
    clean = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200))
    lines = "\n".join(["one line that comes again and again"] * 3 + [clean])
    docs = spark.createDataFrame([(1, clean), (2, (clean[:300] + " ") * 5), (3, "\n".join([clean[:80]] * 4)), (4, lines), (4, lines)], "doc_id bigint, text string")
    got = [(r["doc_id"], r["kept"]) for r in quality.repetition_report(docs).orderBy("doc_id").collect()]
    assert got == [(1, True), (2, False), (3, False), (4, False), (4, False)]


def test_empty_table(spark):
    assert quality.repetition_report(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
