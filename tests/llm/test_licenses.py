from pyspark.sql import functions as F

from cinelake.llm import licenses

MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."


def test_headers_files_and_inheritance(spark):
    rows = [
        (1, f"code\n{MIT}\nmore words here and there", "a/x/one"), (2, "no header at all", "a/x/two"), (3, MIT, "a/LICENSE"), (4, APACHE, "a/x/deep/LICENSE"),
        (5, "plain", "a/x/deep/er/three"), (6, "plain", "b/four"), (7, None, "a/five"), (8, "", None), (9, "our licence to speak freely of other things", "a/x/six"),
        (10, "plain", "ab/seven"), (2, "no header at all", "a/x/two"), (11, APACHE.upper() + "\n" + MIT, "c/eight"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, place string, license string")
    got = {}
    n = 0
    for r in licenses.scan(docs, F.col("place")).collect():
        got[r["doc_id"]] = (r["license"], r["is_license_file"], r["inherited_from"], r["effective_license"], r["n_headers"])
        n += 1
    assert n == len(rows)
    assert got[1] == ("MIT", False, None, "MIT", 1)
    assert got[2] == (None, False, "a", "MIT", 0)
    assert got[3] == ("MIT", True, None, "MIT", 1)
    assert got[4][:2] == ("Apache-2.0", True)
    assert got[5] == (None, False, "a/x/deep", "Apache-2.0", 0)
    assert got[6] == got[8] == got[10] == (None, False, None, None, 0)
    assert got[7] == (None, False, "a", "MIT", 0)
    assert got[9] == (None, False, "a", "MIT", 0)
    assert got[11][0] in ("Apache-2.0", "MIT") and got[11][4] == 2


def test_every_template_finds_itself(spark):
    headers = spark.createDataFrame([(text, 1) for _, text in licenses.TEMPLATES], "header string, n bigint")
    got = {r["header"]: (r["license"], r["score"]) for r in licenses.scored_headers(headers).collect()}
    assert got == {text: (name, 1.0) for name, text in licenses.TEMPLATES}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, path string")
    assert licenses.scan(docs, F.col("path")).count() == 0


def file_text(name, holder):
    """A licence file as people keep it: lines of some 70 characters and a copyright holder."""
    import textwrap

    text = dict(licenses.FULL_TEXTS)[name].replace("Copyright (c)", f"Copyright (c) 2021 {holder}")
    return "\n\n".join(textwrap.fill(p, 70) for p in text.split("\n"))


def test_whole_licence_files_lend_to_their_directory(spark):
    names = [name for name, _ in licenses.FULL_TEXTS]
    rows = []
    for i, name in enumerate(names):
        rows += [(10 * i, file_text(name, "Ann Example"), f"p{i}/LICENSE"), (10 * i + 1, "int main;", f"p{i}/src/a.c"), (10 * i + 2, f"{MIT}\nint x ; int y ; int z ;", f"p{i}/src/b.c")]
    prose = "The committee spoke of the software licence and of many other things that people do in towns. " * 40
    rows += [(900, prose, "q/essay"), (901, "plain", "q/other"), (902, file_text("MIT", "B") + "\n" + prose.replace("licence", "x"), "r/mixed"), (902, None, "r/none")]
    rows += [(0, rows[0][1], "p0/LICENSE"), (None, file_text("ISC", "C"), None)]
    docs = spark.createDataFrame([(*r, "t", 1.5) for r in rows], "doc_id bigint, text string, place string, token string, score double").repartition(6)
    out = licenses.scan(docs, F.col("place")).collect()
    got = {(r["doc_id"], r["path"]): (r["license"], r["is_license_file"], r["inherited_from"], r["effective_license"]) for r in out}
    assert len(out) == len(rows)
    for i, name in enumerate(names):
        assert got[10 * i, f"p{i}/LICENSE"] == (name, True, None, name)
        assert got[10 * i + 1, f"p{i}/src/a.c"] == (None, False, f"p{i}", name)
        assert got[10 * i + 2, f"p{i}/src/b.c"] == ("MIT", False, None, "MIT")
    assert got[900, "q/essay"][:2] == (None, False) and got[901, "q/other"] == (None, False, None, None)
    assert not got[902, "r/mixed"][1] and got[902, "r/none"] == (None, False, None, None)
    assert got[None, None] == ("ISC", True, None, "ISC")


def test_real_files_of_this_machine(spark):
    import os

    import pytest

    place = "/usr/share/common-licenses/Apache-2.0"
    if not os.path.exists(place):
        pytest.skip("no licence texts here")
    with open(place) as f:
        docs = spark.createDataFrame([(1, f.read(), "a/LICENSE"), (2, "code", "a/b/c")], "doc_id bigint, text string, path string")
    got = {r["doc_id"]: (r["effective_license"], r["is_license_file"], r["inherited_from"]) for r in licenses.scan(docs, F.col("path")).collect()}
    assert got == {1: ("Apache-2.0", True, None), 2: ("Apache-2.0", False, "a")}


def test_whole_files_against_plain_arithmetic(spark):
    import math
    import random
    import re

    rng = random.Random(4)
    tokens = lambda t: re.findall(licenses.TOKEN, t.lower())
    full = [(name, tokens(t)) for name, t in licenses.FULL_TEXTS]
    weight = lambda t: math.log((1 + len(full)) / (1 + sum(t in f for _, f in full))) + 1
    vector = lambda ts: {t: ts.count(t) * weight(t) for t in set(ts)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [(name, vector(f)) for name, f in full]
    texts = []
    for i in range(60):
        words = licenses.FULL_TEXTS[i % len(full)][1].split()
        kept = [w for w in words if rng.random() < rng.choice([0.6, 0.9, 1.0])] + [f"word{j}" for j in range(rng.randint(0, 60))]
        texts.append(" ".join(kept))
    texts += [texts[0], "", "only words"]
    want = {}
    for text in texts:
        v = vector(tokens(text))
        scored = [(-round(sum(x * f.get(t, 0) for t, x in v.items()) / (norm(v) * norm(f)), 6), name) for name, f in vectors] if v else []
        good = [s for s in scored if -s[0] >= licenses.FILE_COSINE]
        if good:
            want[text] = (min(good)[1], -min(good)[0])
    rows = spark.createDataFrame([(t, t) for t in texts], "key string, text string")
    got = {r["key"]: (r["license"], r["score"]) for r in licenses.whole_files(rows).collect()}
    assert set(got) == set(want) and 10 < len(want) < 60
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in want)
