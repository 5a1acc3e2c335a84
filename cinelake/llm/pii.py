"""Personal data: exact rules plus candidates judged by gradient-boosted trees.

Every text is scanned for four kinds by fixed rules. Beside them, generators with high recall propose spans that may overlap; boosted trees
weigh their format and context, and a threshold calibrated on held-back candidates selects further spans. What the rules find teaches the
trees how personal data stands in these texts: each hit of every row is written in the other ways people use ("[at]", no "+",
brackets, dots), which the rules miss, and is an example in its own context; candidates that are no hit are the counter-examples.
Scanning and scoring are expressions on the row: no join, no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from cinelake.llm.texts import shielded

#: The kinds in their fixed order. Possessive forms of the greedy patterns: they match the same, but never go back. A match can only begin
#: at the start of a run of its first class or where the last match ended, which spares a scan from every character of a run.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates, wider than the rules; the kind is settled by what a candidate looks like.
GENERATORS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)*+",
    r"(?<![0-9])[+(]?[0-9](?:[ ().-]{0,2}+[0-9])++",
    r"(?<![0-9.])[0-9]++(?:\.[0-9]++)++",
)
#: Words just before a candidate: of contact and payment, and of numbers that are something else.
CUES = r"(?i)\b(?:e-?mails?|phone|tel|telephone|call|fax|mobile|cell|text|contact|reach|write|whatsapp|card|visa|pay)\b"
OTHER_CUES = r"(?i)\b(?:ssn|isbn|issn|doi|order|invoice|account|ref|sku|id|version|serial|date|page|year|case|ticket)\b"
LEAST_PRECISION = 0.95
TREES, DEPTH = 12, 3
_BLOCK, _CONTEXT = 256, 24


def running_sums(values: Column) -> Column:
    """The sums of all earlier values at each place of an array, and the total at its end, in blocks so that long arrays stay linear."""
    n_blocks = F.floor(F.size(values) / _BLOCK) + 1
    blocks = F.transform(F.sequence(F.lit(0).cast("bigint"), n_blocks - 1), lambda b: F.slice(values, (b * _BLOCK + 1).cast("int"), F.lit(_BLOCK)))

    def sums(start: Column, xs: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    totals = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x))
    starts = sums(F.lit(0).cast("bigint"), totals)
    return F.flatten(F.transform(blocks, lambda xs, i: F.slice(sums(F.element_at(starts, i + 1), xs), F.lit(1), F.when(i == n_blocks - 1, F.size(xs) + 1).otherwise(F.size(xs)))))


def located(df: DataFrame, name: str, pattern: str, gate: Column) -> DataFrame:
    """Add array `name` of the matches in column __text: start and end in code points, hit, and the text just before and after."""
    none = F.array().cast("array<string>")
    hits = F.when(gate, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))).otherwise(none)
    df = df.withColumn("__hits", hits).withColumn("__gaps", F.when(F.size("__hits") > 0, F.split("__text", pattern, -1)).otherwise(none))
    lengths = F.flatten(F.zip_with(F.slice("__gaps", F.lit(1), F.size("__hits")), "__hits", lambda g, h: F.array(F.length(g).cast("bigint"), F.length(h).cast("bigint"))))
    df = df.withColumn("__sums", running_sums(lengths))
    found = F.transform(
        "__hits",
        lambda h, i: F.struct(
            F.get("__sums", 2 * i + 1).alias("start"), F.get("__sums", 2 * i + 2).alias("end"), h.alias("hit"),
            F.substring(F.get("__gaps", i), -_CONTEXT, _CONTEXT).alias("before"), F.substring(F.get("__gaps", i + 1), 1, _CONTEXT).alias("after"),
        ),
    )
    return df.withColumn(name, found).drop("__hits", "__gaps", "__sums")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Every second digit from the right counts double (less 9 above 9); the sum must divide by 10."""
    worth = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _is_card(hit: Column) -> Column:
    digits = _digits(hit)
    return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), passes_luhn(digits)).otherwise(False)


def _is_quad(hit: Column) -> Column:
    """Parts of at most 255, leading zeros or not."""
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(hit, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255"))


RULES = {"email": lambda hit: F.lit(True), "ip": _is_quad, "card": _is_card, "phone": lambda hit: F.length(_digits(hit)).between(9, 15)}
_GATES = {"email": lambda t: F.contains(t, F.lit("@")), "phone": lambda t: F.contains(t, F.lit("+"))}


def _scanned(docs: DataFrame, text: str, candidates: bool = True) -> DataFrame:
    """`docs` with __text, the base spans of each kind as __<kind>, and __candidates with their features."""
    df = docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn("__digit", F.regexp_like("__text", F.lit("[0-9]")))
    for kind, pattern in KINDS.items():
        df = located(df, f"__{kind}", pattern, _GATES.get(kind, lambda t: F.col("__digit"))(F.col("__text")))
        df = df.withColumn(f"__{kind}", F.filter(f"__{kind}", lambda s: RULES[kind](s["hit"])))  # noqa: B023 (used at once)
    if candidates:
        at = F.regexp_like("__text", F.lit(r"@|[\[(]at[\])]"))
        for i, pattern in enumerate(GENERATORS):
            df = located(df, f"__g{i}", pattern, at if i == 0 else F.col("__digit"))
        wide = F.filter(F.concat(*(f"__g{i}" for i in range(len(GENERATORS)))), lambda s: F.regexp_like(s["hit"], F.lit(r"[@\[(]")) | (F.length(_digits(s["hit"])) >= 7))
        df = df.withColumn("__candidates", F.array_distinct(wide)).drop(*(f"__g{i}" for i in range(len(GENERATORS))))
    return df


def _features(s: Column) -> list[Column]:
    """Format and context of a candidate as numbers; none of them is a rule's own check."""
    hit, before, after = s["hit"], F.coalesce(s["before"], F.lit("")), F.coalesce(s["after"], F.lit(""))
    digits = _digits(hit)
    count = lambda chars: F.length(hit) - F.length(F.regexp_replace(hit, chars, ""))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    groups = F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))
    long_enough = F.when(F.length(digits).between(13, 19), digits)
    found = [
        F.length(digits), F.length(hit), count(r"[ ()-]"), count(r"\."), count("@"), count("[A-Za-z]"), flag(F.regexp_like(hit, F.lit(r"[\[(](?:at|dot)[\])]"))),
        F.size(groups), F.length(F.coalesce(F.get(groups, F.lit(0)), F.lit(""))), F.length(F.coalesce(F.element_at(groups, F.when(F.size(groups) > 0, -1)), F.lit(""))),
        flag(hit.startswith("(")), flag(hit.startswith("0")), flag(passes_luhn(long_enough)), flag(F.regexp_like(before, F.lit(CUES))), flag(F.regexp_like(before, F.lit(OTHER_CUES))),
        flag(F.regexp_like(before, F.lit("[A-Za-z0-9]$"))), flag(F.regexp_like(after, F.lit("^[A-Za-z0-9]"))), flag(F.regexp_like(hit, F.lit(r"(?:\.|[\[(]dot[\])]) ?[A-Za-z]{2,}$"))),
    ]
    return [f.cast("double") for f in found]


def _rewritten(kind: Column, hit: Column) -> Column:
    """The other ways in which people write a hit: an array of texts that the rules do not know."""
    digits = _digits(hit)
    ten = F.substring(digits, -10, 10)
    local, host = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
    parts = [F.substring(ten, 1, 3), F.substring(ten, 4, 3), F.substring(ten, 7, 4)]
    grouped = lambda by: F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1" + by)
    emails = F.array(
        F.concat(local, F.lit(" [at] "), F.replace(host, F.lit("."), F.lit(" [dot] "))), F.concat(local, F.lit("(at)"), F.replace(host, F.lit("."), F.lit("(dot)"))),
        F.concat(local, F.lit(" [at] "), host), F.concat(local, F.lit(" @ "), host),
    )
    phones = F.array(
        F.concat(F.lit("("), parts[0], F.lit(") "), parts[1], F.lit("-"), parts[2]), F.concat_ws("-", *parts), F.concat_ws(".", *parts), F.concat_ws(" ", *parts),
        F.concat(F.lit("00"), F.substring(hit, 2, 1_000)),
    )
    cards = F.array(grouped("."), grouped("  "))
    return F.when(kind == "email", emails).when((kind == "phone") & (F.length(digits) >= 10), phones).when(kind == "card", cards).otherwise(F.array().cast("array<string>"))


def _plausible(s: Column) -> Column:
    """A candidate that may well be personal data though no rule knows it: a contact word before it, and a usual shape. Not a counter-example."""
    shape = F.regexp_like(s["hit"], F.lit(r"[@\[(](?:at)?")) | (F.length(_digits(s["hit"])).between(10, 19) & ~F.regexp_like(s["hit"], F.lit("^[0-9]+$")))
    return F.regexp_like(F.coalesce(s["before"], F.lit("")), F.lit(CUES)) & shape


def _base(df_kind: str):
    return F.transform(df_kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def _clear_of_rules(s: Column) -> Column:
    spans = F.concat(*(_base(f"__{k}") for k in KINDS))
    return ~F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def _tree_sql(text: str) -> list[str]:
    """The trees of a printed ensemble as nested CASE expressions on x[feature]."""
    lines = [line.strip() for line in text.split("\n")]
    at = 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return f"({float(line.split()[1])!r}D)"
        feature, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        yes = node()
        at += 1
        return f"CASE WHEN x[{feature}] <= {float(bound)!r}D THEN {yes} ELSE {node()} END"

    trees = []
    while at < len(lines):
        if lines[at].startswith(("If", "Predict")):
            trees.append(node())
        else:
            at += 1
    return trees


class SpanModel:
    """Boosted trees and a threshold, as an expression of a candidate."""

    def __init__(self, trees: list[str], weights: list[float], threshold: float):
        margin = " + ".join(f"{w!r}D * ({t})" for w, t in zip(weights, trees)) or "0D"
        self.margin, self.threshold = margin, threshold

    def score(self, s: Column) -> Column:
        """The probability that a candidate is personal data."""
        margin = F.transform(F.array(F.array(*_features(s))), lambda x: _on(self.margin, x))
        return 1 / (1 + F.exp(-2 * F.get(margin, F.lit(0))))

    def selects(self, s: Column) -> Column:
        return self.score(s) >= self.threshold


def _on(sql: str, x: Column) -> Column:
    """The trees' expression with x bound to a column: CASE expressions built from their text."""
    token = re.compile(r"CASE WHEN x\[(\d+)\] <= (\S+?)D THEN |( ELSE )|( END)|\((-?[0-9.eE+-]+)D\)")
    at = 0

    def node() -> Column:
        nonlocal at
        m = token.search(sql, at)
        at = m.end()
        if m[5] is not None:
            return F.lit(float(m[5]))
        yes = node()
        at = token.search(sql, at).end()
        no = node()
        at = token.search(sql, at).end()
        return F.when(F.get(x, F.lit(int(m[1]))) <= float(m[2]), yes).otherwise(no)

    total = F.lit(0.0)
    for m in re.finditer(r"(-?[0-9.eE+-]+)D \* \(", sql):
        if m.start() < at:
            continue
        at = m.end()
        total = total + float(m[1]) * node()
    return total


def _examples(part: DataFrame) -> DataFrame:
    """x (features), label (1 for a rewritten hit, 0 for a candidate that is no hit) and k (a hash) of every example in column text."""
    scanned = _scanned(part, "text")
    candidate = lambda label: lambda s: F.struct(F.array(*_features(s)).alias("x"), F.lit(label).alias("label"), F.xxhash64(s).alias("k"))
    negative = F.transform(F.filter("__candidates", lambda s: _clear_of_rules(s) & ~_plausible(s)), candidate(0.0))

    def written(kind: str) -> Column:
        every = F.transform(f"__{kind}", lambda s: F.transform(_rewritten(F.lit(kind), s["hit"]), lambda h: F.struct(s["before"].alias("before"), h.alias("hit"), s["after"].alias("after"))))
        return F.flatten(every)

    snippets = scanned.select(F.explode(F.concat(*(written(k) for k in KINDS))).alias("s")).select(
        F.concat("s.before", "s.hit", "s.after").alias("text"), F.length("s.before").alias("from"), (F.length("s.before") + F.length("s.hit")).alias("upto")
    )
    # a candidate stands for the hit if they share at least four fifths of their joint stretch
    shared = lambda s: F.least(s["end"], F.col("upto")) - F.greatest(s["start"], F.col("from"))
    joint = lambda s: F.greatest(s["end"], F.col("upto")) - F.least(s["start"], F.col("from"))
    found = _scanned(snippets, "text")
    positive = F.transform(F.filter("__candidates", lambda s: _clear_of_rules(s) & (5 * shared(s) >= 4 * joint(s))), candidate(1.0))
    return scanned.select(F.explode(negative).alias("c")).unionByName(found.select(F.explode(positive).alias("c"))).select("c.*")


def train(docs: DataFrame, text: str = "text") -> SpanModel | None:
    """Boosted trees taught by the rewritten hits and other candidates of every row. Examples with the same features and label are one
    weighted row, so what the trees see is as long as there are different examples; the threshold is judged on all held-back ones.

    None if there are examples of one class only: then the rules stand alone.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    held = (F.pmod(F.xxhash64("k"), F.lit(4)) == 0).alias("held")
    merged = _examples(docs.select(F.col(text).alias("text"))).groupBy("x", "label", held).agg(F.count(F.lit(1)).cast("double").alias("n"))
    seen = merged.sortWithinPartitions("x", "label", "held").withColumn("features", array_to_vector("x")).persist()
    try:
        if seen.filter(~F.col("held")).select("label").distinct().count() < 2:
            return None
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, weightCol="n").fit(seen.filter(~F.col("held")))
        judged = model.transform(seen.filter("held")).select("label", "n", F.ceil(vector_to_array("probability")[1] * 100).alias("bin"))
        bins = {r["bin"]: (r["n"], r["good"]) for r in judged.groupBy("bin").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("good")).collect()}
    finally:
        seen.unpersist()
    threshold, n, good = 1.0, 0, 0.0
    for b in sorted(bins, reverse=True):  # the lowest threshold whose precision on held-back candidates is high enough
        n, good = n + bins[b][0], good + bins[b][1]
        if good / n >= LEAST_PRECISION:
            threshold = min(threshold, max(0.5, (b - 1) / 100))
    return SpanModel(_tree_sql(model.toDebugString), list(model.treeWeights), threshold)


def find_spans(docs: DataFrame, model: SpanModel | None, text: str = "text") -> DataFrame:
    """`docs` with __base and __all: arrays of (order, kind, start, end), in the order of kinds, then start. Offsets are code points, end exclusive."""
    df = _scanned(docs, text, candidates=model is not None)

    def named(kind: Column, s: Column) -> Column:
        order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), kind)
        return F.struct(order.alias("order"), s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"))

    base = F.concat(*(F.transform(f"__{k}", lambda s: named(F.lit(k), s)) for k in KINDS))  # noqa: B023 (used at once)
    df = df.withColumn("__base", base)
    if model is None:
        return df.withColumn("__all", F.col("__base")).drop("__digit", "__text", *(f"__{k}" for k in KINDS))

    def kind(s: Column) -> Column:
        hit = s["hit"]
        return (
            F.when(F.regexp_like(hit, F.lit(r"@|[\[(]at[\])]")), F.lit("email"))
            .when(F.length(_digits(hit)) >= 13, F.lit("card"))
            .when(F.regexp_like(hit, F.lit(r"^[0-9]+(?:\.[0-9]+){3,}$")), F.lit("ip"))
            .otherwise(F.lit("phone"))
        )

    more = F.filter("__candidates", lambda s: _clear_of_rules(s) & model.selects(s))
    df = df.withColumn("__all", F.array_sort(F.array_distinct(F.concat("__base", F.transform(more, lambda s: named(kind(s), s))))))
    return df.drop("__digit", "__text", "__candidates", *(f"__{k}" for k in KINDS))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the number of rule spans of each kind, the digest of the rule spans, and all spans, for every row; whole texts.

    A null or empty text has no spans. Repeated rows and null ids give a row each; an empty table gives none.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = find_spans(rows, train(rows))
    counts = [F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}") for k in KINDS]  # noqa: B023 (used at once)
    return found.select("doc_id", *counts, F.sha2(_listed("__base").cast("binary"), 256).alias("base_sha256"), _listed("__all").alias("spans"))


def redact(docs: DataFrame, model: SpanModel | None, text: str = "text", mark: str = "[removed]") -> DataFrame:
    """`docs`, same columns, with `mark` in place of every selected span (spans that touch or overlap become one).

    Columns may have any names; a null text stays null; repeated rows are rows; no rows give no rows.
    """
    names = docs.columns
    docs = shielded(docs)
    found = find_spans(docs, model, text)
    spans = F.array_sort(F.transform("__all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] > acc["upto"]
        kept = F.when(s["start"] > acc["upto"], F.concat(F.substring(F.col(text), (acc["upto"] + 1).cast("int"), (s["start"] - acc["upto"]).cast("int")), F.lit(mark))).otherwise(F.when(acc["upto"] == 0, F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.concat(acc["parts"], F.array(kept)).alias("parts"), F.greatest(acc["upto"], s["end"]).alias("upto"), (acc["n"] + fresh.cast("int")).alias("n"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("bigint").alias("upto"), F.lit(0).alias("n"))
    joined = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col(text), (acc["upto"] + 1).cast("int"), F.length(F.col(text)))))
    return found.withColumn(text, F.when(F.size("__all") > 0, joined).otherwise(F.col(text))).select(*docs.columns).toDF(*names)
