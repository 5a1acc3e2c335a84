"""Language of a text: known words by their frequency in each language, unseen words by ever shorter character n-grams.

Counts grow with the corpus and are never cut. Words that make up at least one in `FREQUENT` of all words, of which there can be no more
than `FREQUENT`, are looked up where the text is read; all others meet the word table in a shuffle. Log frequencies are whole numbers of
1/1024, so that sums do not depend on their order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from cinelake.llm.texts import Spans, kept_in_worker, mix
from cinelake.session import cut_lineage

UNKNOWN = "und"
#: Longest n-gram of an unseen word; words are fenced by a blank on both sides.
ORDER = 5
#: Added to every count.
FLOOR = 0.5
UNIT = 1024
#: Bound of what is broadcast, in cells of (word or n-gram, language); a lookup of more cells is a join.
CELLS = 8_000_000
#: Entries of a counter in a task before it is sent out.
ENTRIES = 400_000
PIECE = 1 << 20

_RUN = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")
_WORD = re.compile(r"\W")


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about a million characters, cut where no word is."""
    start = 0
    while len(text) - start > PIECE:
        cut = _WORD.search(text, start + PIECE)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def word_counts(text: str | None) -> Counter:
    """How often each lowered run of letters occurs in the whole text."""
    counts: Counter = Counter()
    for piece in _pieces(text or ""):
        counts.update(_RUN.findall(piece.lower()))
    odd = [w for w in counts if not w.isalpha()]
    for w in odd:
        n = counts.pop(w)
        for part in _LETTERS.findall(w):
            counts[part] += n
    return counts


def _hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of whole words."""
    codes, bounds = _codes(words)
    return Spans(mix(codes)).of(bounds[:-1], bounds[1:])


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=bounds[1:])
    text = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(text, np.uint32).astype(np.uint64) + np.uint64(1), bounds


def _grams(words: list[str], order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, word, place of the last character, hash) of every n-gram of the fenced words, longest n first."""
    codes, bounds = _codes([f" {w} " for w in words])
    spans = Spans(mix(codes))
    word = np.repeat(np.arange(len(words)), np.diff(bounds))
    for n in range(order, 0, -1):
        if len(codes) < n:
            continue
        whole = np.flatnonzero(word[n - 1 :] == word[: len(word) - n + 1])
        yield n, word[whole], whole + n - 1, spans.of(whole, whole + n) ^ np.uint64(n)


def _counted(languages: list[str]):
    """Task: (word, n, c0, c1, ...) of its texts; n counts all rows, c of a language the rows that may be learned from."""
    names = {v: i for i, v in enumerate(languages)}

    def rows(counts: dict[int, Counter]) -> pa.RecordBatch:
        place: dict[str, int] = {}
        for c in counts.values():
            for w in c:
                place.setdefault(w, len(place))
        table = np.zeros((len(languages) + 1, len(place)), np.int64)
        for i, c in counts.items():
            table[i, [place[w] for w in c]] = list(c.values())
        columns = {"word": list(place), "n": table.sum(0), **{f"c{i}": table[i] for i in range(len(languages))}}
        return pa.RecordBatch.from_pydict(columns, schema=schema)

    schema = pa.schema([("word", pa.string()), ("n", pa.int64())] + [(f"c{i}", pa.int64()) for i in range(len(languages))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                counts.setdefault(names.get(lang, len(languages)), Counter()).update(word_counts(text.as_py()))
                if sum(map(len, counts.values())) > ENTRIES:
                    yield rows(counts)
                    counts = {}
        if counts:
            yield rows(counts)

    return run


def _log_shares(counts: np.ndarray, totals: np.ndarray, kinds: int) -> np.ndarray:
    return np.rint(UNIT * (np.log(counts + FLOOR) - np.log(totals + FLOOR * max(kinds, 1)))).astype(np.int64)


def _learned(words: DataFrame, n_languages: int) -> DataFrame:
    """Words that occur in what may be learned from."""
    return words.filter(sum(F.col(f"c{i}") for i in range(n_languages)) > 0)


def _gram_counts(n_languages: int):
    names = [f"c{i}" for i in range(n_languages)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.stack([np.asarray(batch.column(c)) for c in names], 1) if batch.num_rows else None
            if table is None:
                continue
            for n, word, _, gram in _grams(batch.column("word").to_pylist(), ORDER):
                kinds, place = np.unique(gram, return_inverse=True)
                sums = [np.bincount(place, table[word, i], len(kinds)).astype(np.int64) for i in range(n_languages)]
                yield pa.RecordBatch.from_pydict({"gram": kinds.view(np.int64), "n": np.full(len(kinds), n, np.int32), **dict(zip(names, sums))})

    return run


def _totals(table: DataFrame, n_languages: int, *by: str) -> dict:
    sums = [F.sum(f"c{i}").alias(f"c{i}") for i in range(n_languages)]
    rows = table.groupBy(*by).agg(F.count(F.lit(1)).alias("kinds"), *sums).collect()
    return {tuple(r[b] for b in by): (np.array([r[f"c{i}"] or 0 for i in range(n_languages)], float), r["kinds"]) for r in rows}


def _worded(n_languages: int, totals, order_totals, grams: tuple[np.ndarray, np.ndarray] | None):
    """Task over the word table: (word, n, s0, s1, ...), log frequencies of known words and, given the n-grams, of unseen ones."""
    names = [f"c{i}" for i in range(n_languages)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.stack([np.asarray(batch.column(c)) for c in names], 1)
            scores = _log_shares(table, *totals)
            unseen = np.flatnonzero(table.sum(1) == 0)
            if len(unseen):
                words = batch.column("word").take(pa.array(unseen)).to_pylist()
                keys, cells = grams
                sums, places = np.zeros((len(words), n_languages), np.int64), np.zeros(len(words), np.int64)
                done: np.ndarray | None = None
                for n, word, last, gram in _grams(words, ORDER):
                    if done is None:
                        done = np.zeros(sum(len(w) + 2 for w in words), bool)
                    at = np.minimum(np.searchsorted(keys, gram), max(len(keys) - 1, 0))
                    hit = (keys[at] == gram if len(keys) else np.zeros(len(gram), bool)) & ~done[last]
                    np.add.at(sums, word[hit], cells[at[hit]])
                    np.add.at(places, word[hit], 1)
                    done[last[hit]] = True
                scores[unseen] = sums // np.maximum(places, 1)[:, None]
            yield pa.RecordBatch.from_pydict({"word": batch.column("word"), "n": batch.column("n"), **{f"s{i}": scores[:, i] for i in range(n_languages)}})

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, place, order, gram) of every n-gram of unseen words."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        for n, word, last, gram in _grams(words, ORDER):
            yield pa.RecordBatch.from_pydict(
                {"word": batch.column("word").take(pa.array(word)), "n": batch.column("n").take(pa.array(word)), "place": last.astype(np.int64),
                 "order": np.full(len(word), n, np.int32), "gram": gram.view(np.int64)}
            )


def _joined_backoff(unseen: DataFrame, grams: DataFrame, n_languages: int) -> DataFrame:
    """Scores of unseen words by joining their n-grams: of each place the longest that is known, averaged over places."""
    asked = unseen.select("word", "n").mapInArrow(_asked, "word string, n bigint, place bigint, order int, gram bigint")
    best = F.max_by(F.struct(*[f"s{i}" for i in range(n_languages)]), "order").alias("best")
    found = asked.join(grams.drop("n"), "gram").groupBy("word", "n", "place").agg(best)
    means = [F.floor(F.sum(f"best.s{i}") / F.count(F.lit(1))).cast("bigint").alias(f"s{i}") for i in range(n_languages)]
    rest = unseen.select("word", "n").join(found.groupBy("word", "n").agg(*means), ["word", "n"], "left")
    return rest.na.fill(0, [f"s{i}" for i in range(n_languages)])


def word_scores(spark: SparkSession, learnable: DataFrame, languages: list[str], cells: int = CELLS) -> DataFrame:
    """(word, n, s0, s1, ...): occurrences and log frequency by language of every word of `learnable` (text, lang).

    Rows whose lang is not in `languages` only have their words listed. `cells` bounds the n-grams that are broadcast.
    """
    k = len(languages)
    schema = "word string, n bigint, " + ", ".join(f"c{i} bigint" for i in range(k))
    counted = learnable.select("text", "lang").mapInArrow(_counted(languages), schema)
    words = cut_lineage(counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in counted.columns[1:]]))
    totals = _totals(_learned(words, k), k).get((), (np.zeros(k), 0))
    gram_schema = "gram bigint, n int, " + ", ".join(f"c{i} bigint" for i in range(k))
    raw = _learned(words, k).mapInArrow(_gram_counts(k), gram_schema)
    grams = cut_lineage(raw.groupBy("gram", "n").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]))
    orders = {n: v for (n,), v in _totals(grams, k, "n").items()}
    scored = _scored_grams(grams, orders, k)
    out = "word string, n bigint, " + ", ".join(f"s{i} bigint" for i in range(k))
    n_grams = sum(v[1] for v in orders.values())
    if n_grams * k <= cells:
        held = scored.orderBy("gram").toArrow()
        keys = np.asarray(held.column("gram")).view(np.uint64)
        order = np.argsort(keys)
        table = np.stack([np.asarray(held.column(f"s{i}"), np.int64) for i in range(k)], 1)[order] if len(keys) else np.zeros((0, k), np.int64)
        return cut_lineage(words.mapInArrow(_with_model(spark, (keys[order], table), lambda m: _worded(k, totals, orders, m)), out))
    known = _learned(words, k).mapInArrow(_worded(k, totals, orders, None), out)
    unseen = words.filter(sum(F.col(f"c{i}") for i in range(k)) == 0)
    return cut_lineage(known.unionByName(_joined_backoff(unseen, scored, k)))


def _scored_grams(grams: DataFrame, orders: dict, k: int) -> DataFrame:
    """(gram, n, s0, s1, ...) with log frequencies among n-grams of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column("n"))
            table = np.stack([np.asarray(batch.column(f"c{i}")) for i in range(k)], 1)
            scores = np.zeros(table.shape, np.int64)
            for length, totals in orders.items():
                scores[n == length] = _log_shares(table[n == length], *totals)
            yield pa.RecordBatch.from_pydict({"gram": batch.column("gram"), "n": batch.column("n"), **{f"s{i}": scores[:, i] for i in range(k)}})

    return grams.mapInArrow(run, "gram bigint, n int, " + ", ".join(f"s{i} bigint" for i in range(k)))


def _with_model(spark: SparkSession, model, make):
    """A task function over a broadcast model."""
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(held.value)(batches)

    return run


def _looked_up(k: int):
    """Task maker: one row per text with the sums over frequent words, and one row per other word, to be joined."""
    names = [f"s{i}" for i in range(k)]
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("lookup", pa.string()), ("n", pa.int64()), ("n_words", pa.int64())] + [(c, pa.int64()) for c in names]
    )

    def make(model):
        keys, table = model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, 64):
                    yield one(batch.slice(first, 64))

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = [word_counts(t.as_py()) for t in batch.column("text")]
            text = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
            words = [w for c in counts for w in c]
            n = np.array([v for c in counts for v in c.values()], np.int64)
            hashes = _hashes(words)
            at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
            hit = keys[at] == hashes if len(keys) else np.zeros(len(words), bool)
            sums = np.zeros((len(counts), k), np.int64)
            np.add.at(sums, text[hit], table[at[hit]] * n[hit, None])
            total = np.bincount(text, n, len(counts)).astype(np.int64)
            rest = np.flatnonzero(~hit)
            rows = np.asarray(batch.column("row"))
            none = np.zeros(len(rest), np.int64)
            # no word starts with a digit, so a text's own row matches nothing and lies anywhere
            columns = {
                "row": np.concatenate([rows, rows[text[rest]]]),
                "doc_id": pa.concat_arrays([batch.column("doc_id"), pa.nulls(len(rest), pa.int64())]),
                "lookup": [str(r) for r in rows] + [words[i] for i in rest],
                "n": np.concatenate([np.zeros(len(counts), np.int64), n[rest]]),
                "n_words": np.concatenate([total, none]),
                **{c: np.concatenate([sums[:, i], none]) for i, c in enumerate(names)},
            }
            return pa.RecordBatch.from_pydict(columns, schema=schema)

        return run

    return make, "row bigint, doc_id bigint, lookup string, n bigint, n_words bigint, " + ", ".join(f"{c} bigint" for c in names)


def predict(docs: DataFrame, learn: str = "true", cells: int = CELLS) -> DataFrame:
    """(doc_id, lang_pred, score, n_words): the likeliest language of every whole text, one row per row of `docs` (doc_id, text, lang).

    Learned from the rows that meet the SQL condition `learn` and have a lang; every lang value among them is a language (each adds a column
    to the tables, so their number should be in the hundreds at most). The score is the probability of the language, given equal priors and
    the mean log frequency of the text's words; ties go to the language first by code point.

    A null text or one without a letter is `und` with score 0, and so is everything if nothing was learned. A text all of whose characters are
    unknown scores equally for all. Repeated rows are rows; a null doc_id stays null; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.when(F.expr(learn), F.col("lang")).alias("lang"))
    languages = sorted(r[0] for r in base.select("lang").where("lang is not null").distinct().collect())
    if not languages:
        return base.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("bigint").alias("n_words"))
    k = len(languages)
    words = word_scores(spark, base, languages, cells)
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = cells // (k + 1)
    often = F.col("n") * frequent >= total
    held = words.filter(often).toArrow()
    keys = _hashes(held.column("word").to_pylist())
    order = np.argsort(keys)
    table = np.stack([np.asarray(held.column(f"s{i}"), np.int32) for i in range(k)], 1)[order] if len(keys) else np.zeros((0, k), np.int32)
    make, schema = _looked_up(k)
    placed = base.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    asked = placed.mapInArrow(_with_model(spark, (keys[order], table), make), schema)
    rare = words.filter(~often).select(F.col("word").alias("lookup"), *[F.col(f"s{i}").alias(f"w{i}") for i in range(k)])
    # a frequent word is never asked for, so no asked word is more than one in `frequent` of all
    met = asked.join(rare, "lookup", "left")
    sums = [F.sum(F.col(f"s{i}") + F.coalesce(F.col(f"w{i}"), F.lit(0)) * F.col("n")).alias(f"s{i}") for i in range(k)]
    scored = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), *sums)
    logs = [F.col(f"s{i}") / (UNIT * F.col("n_words")) for i in range(k)]
    top = F.greatest(*logs) if k > 1 else logs[0]
    best = F.lit(None).cast("string")
    for i in reversed(range(k)):
        best = F.when(logs[i] == top, F.lit(languages[i])).otherwise(best)
    share = F.lit(1.0) / sum(F.exp(x - top) for x in logs)
    return scored.select(
        "doc_id",
        F.when(F.col("n_words") > 0, best).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("n_words") > 0, share).otherwise(0.0).alias("score"),
        "n_words",
    )
