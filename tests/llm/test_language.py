"""Language of texts against a plain version, and on held-out documents."""

import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import pytest
import regex

from cinelake.llm import language
from cinelake.llm.queries import op12_language_id

SCHEMA = "doc_id bigint, text string, lang string, row string"


def words_of(text):
    return regex.findall(r"\p{L}+", (text or "").lower())


def grams_of(word, n):
    fenced = f" {word} "
    return {i + n - 1: fenced[i : i + n] for i in range(len(fenced) - n + 1)}


def brute(rows, learned):
    """{row: (lang, score)} by the same rule on plain dictionaries."""
    langs = sorted({lang for i, t, lang in rows if lang is not None and learned(i)})
    counts = {lang: Counter() for lang in langs}
    for i, t, lang in rows:
        if lang is not None and learned(i):
            counts[lang].update(words_of(t))
    known = {w for c in counts.values() for w in c}
    total = {lang: sum(counts[lang].values()) for lang in langs}
    grams = defaultdict(Counter)
    kinds = defaultdict(set)
    for lang in langs:
        for w, c in counts[lang].items():
            for n in range(1, 6):
                for g in grams_of(w, n).values():
                    grams[lang, n][g] += c
                    kinds[n].add(g)

    def share(c, t, k):
        return round(1024 * (math.log(c + 0.5) - math.log(t + 0.5 * max(k, 1))))

    def score(w):
        if w in known:
            return [share(counts[lang][w], total[lang], len(known)) for lang in langs]
        sums, places = [0] * len(langs), 0
        for at in range(len(w) + 2):
            for n in range(5, 0, -1):
                g = grams_of(w, n).get(at)
                if g in kinds[n]:
                    places += 1
                    for j, lang in enumerate(langs):
                        sums[j] += share(grams[lang, n][g], sum(grams[lang, n].values()), len(kinds[n]))
                    break
        return [s // max(places, 1) for s in sums]

    out = []
    for i, t, _ in rows:
        ws = words_of(t)
        if not ws:
            out.append((i, "und", 0.0))
            continue
        sums = [sum(x) for x in zip(*[score(w) for w in ws])]
        best = max(range(len(langs)), key=lambda j: (sums[j], -j))
        logs = [s / (1024 * len(ws)) for s in sums]
        out.append((i, langs[best], 1 / sum(math.exp(x - logs[best]) for x in logs)))
    return out


def corpus(n):
    rng = random.Random(5)
    parts = {"a": ["th", "er", "on", "ing", "ed"], "b": ["sch", "ein", "ung", "ü", "er"], "c": ["ción", "los", "que", "er", "ñ"]}
    rows = []
    for i in range(n):
        lang = rng.choice("abc")
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(1, 40)))
        rows.append((i, text, lang if rng.random() < 0.9 else None))
    return rows


ODD = [
    (900, None, "a"), (901, "", "a"), (902, "12 + 3 = ² ½ _", "b"), (903, "Ωmega 漢字", None), (904, "漢字", None), (None, "er ing", "a"),
    (905, "ER Ing", None), (905, "ER Ing", None), (906, "x" * 3000 + " the", "c"), (907, "th9er_on'ed", None),
]


@pytest.mark.parametrize("cells", [language.CELLS, 200, 0])
def test_like_a_plain_version_whatever_is_broadcast(spark, cells):
    rows = corpus(150) + ODD
    docs = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA).repartition(5)
    got = sorted(((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.predict(docs, "doc_id % 4 <> 2", cells).collect()), key=repr)
    want = sorted(((i, p, round(s, 9)) for i, p, s in brute(rows, lambda i: i is not None and i % 4 != 2)), key=repr)
    assert got == want


def test_pieces_keep_every_word():
    text = "".join(random.Random(1).choices(["ab", " ", "cé", ".", "9"], k=900_000))
    assert len(text) > language.PIECE
    assert language.word_counts(text) == Counter(words_of(text))


def test_nothing_learned_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some words", None, ""), (2, None, "a", "")], SCHEMA)
    assert {(r.doc_id, r.lang_pred, r.score) for r in language.predict(docs, "doc_id = 7").collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert {(r.doc_id, r.lang_pred) for r in language.predict(docs, "doc_id = 2").collect()} == {(1, "a"), (2, "und")}
    assert language.predict(docs.limit(0)).collect() == []


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = op12_language_id(spark, folder).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(got) == len(langs)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.9
