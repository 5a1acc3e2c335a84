"""Toxicity by class-conditional Kneser-Ney models of characters.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary texts, share their lower orders: continuation counts pooled over both
classes, so that an expression too rare in one class is smoothed by the same backoff in both and only evidence moves the ratio. What a text
is scored by is the difference of the two log-likelihoods per character, over the text and over its most suspicious stretch of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cinelake.llm.registry import release_shuffles
from cinelake.llm.texts import free_name, mix, runs
from cinelake.session import cut_lineage

ORDER = 6
DISCOUNT = 0.75
#: Texts of about so many bytes ask for their distinct n-grams together; what they hold travels in pieces of PIECE_BYTES.
BLOCK_BYTES, PIECE_BYTES = 32 << 20, 4 << 20
#: The table of log ratios is dealt to shards of about this many rows; a task holds one shard at a time.
SHARD_ROWS, LEAST_SHARDS = 500_000, 64
#: A worker merges what it holds whenever about so many numbers came in, and hands on counts of so many n-grams in batches of so many rows.
MERGE_GRAMS, MOST_GRAMS, BATCH_GRAMS = 1 << 20, 2 << 20, 1 << 16
STRETCHES = (1, 3, 10)
#: The calibration is fitted on at most about this many labelled rows.
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.3
#: Labelled ids are marked in a bitmap of about so many bits each, in blocks of BLOCK_BITS (as `bitmap_construct_agg` makes them), at most MOST_BLOCKS (8 MB).
BITS_PER_ID, BLOCK_BITS, MOST_BLOCKS = 16, 1 << 15, 2048
RIDGE = 1.0
#: Log odds that a text is toxic before anything is known of it, and the least spread of a feature.
PRIOR, LEAST_DEVIATION = -2.2, 1e-3
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[_SPACE] = 32


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram ending at each byte as a number, mask of complete ones): lower-case bytes, white space as one blank, within a text."""
    folded = _LOWER[data].astype(np.uint64)
    gram = np.zeros(len(data), np.uint64)
    for back in range(ORDER):
        part = np.full(len(data), 32, np.uint64)
        part[back:] = folded[: len(data) - back] if back else folded
        gram |= part << np.uint64(8 * back)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    return gram, place >= ORDER - 1


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """Ascending, each once. `np.unique` may build a hash table many times as large."""
    numbers = np.sort(numbers)
    new = np.ones(len(numbers), bool)
    np.not_equal(numbers[1:], numbers[:-1], out=new[1:])
    return numbers[new]


def _added_up(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One ascending array of keys and the sum of each one's counts; `held` is emptied."""
    keys, counts = (np.concatenate([h[c] for h in held]) for c in range(2))
    held.clear()
    order = np.argsort(keys)
    keys = keys[order]
    counts = counts[order]
    del order
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return keys[new], np.add.reduceat(counts, np.flatnonzero(new)) if len(keys) else counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of n-grams by half and class; merged within the task so that each n-gram leaves it about once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []  # n-gram and column as one number, and how often it was met
    coming = 0
    for batch in batches:
        group = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
        for first, data, offsets in runs(batch.column(0)):
            gram, whole = _grams(data, offsets)
            gram <<= np.uint64(2)
            gram |= np.repeat(group[first : first + len(offsets) - 1], np.diff(offsets))
            keys = np.sort(gram[whole])
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            held.append((keys[at], np.diff(np.append(at, len(keys)))))
            coming += len(at)
            if coming > MERGE_GRAMS:
                held, coming = [_added_up(held)], 0
                if len(held[0][0]) > MOST_GRAMS:
                    yield from _partial(*held.pop())
    if held:
        yield from _partial(*_added_up(held))


COUNTS = ("ordinary_a", "toxic_a", "ordinary_b", "toxic_b")


def _partial(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ascending keys and counts as one row for every n-gram, a few at a time."""
    grams = keys >> np.uint64(2)
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(grams))
    for i in range(0, len(starts), BATCH_GRAMS):
        here, last = starts[i : i + BATCH_GRAMS], ends[min(i + BATCH_GRAMS, len(ends)) - 1]
        table = np.zeros((len(COUNTS), len(here)), np.int64)
        some = slice(here[0], last)
        row = np.repeat(np.arange(len(here)), np.diff(np.append(here, last)))
        table[(keys[some] & np.uint64(3)).astype(np.int64), row] = counts[some]
        yield pa.RecordBatch.from_arrays([pa.array(grams[here].astype(np.int64)), *(pa.array(c) for c in table)], ["gram", *COUNTS])


def log_ratios(grams: DataFrame) -> DataFrame:
    """(kind, key, ratio, weight): the log of toxic over ordinary probability, by n-gram (kind 1) and, for n-grams never counted, by context (kind 0).

    `grams` holds gram (ORDER bytes as a number, the last lowest), toxic and ordinary counts. The lower orders are continuation counts
    over the distinct n-grams of both classes, interpolated down to single characters.
    """
    d = DISCOUNT
    grams = grams.withColumn("context", F.shiftrightunsigned("gram", 8))
    tail = lambda order: F.lit((1 << (8 * order)) - 1)
    followed, source = {}, grams.select(F.col("gram").alias("suffix"))
    for order in range(ORDER - 1, 0, -1):
        source = followed[order] = cut_lineage(source.groupBy(F.col("suffix").bitwiseAND(tail(order)).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))).select("suffix", "n")
    shared = followed[1].select("suffix", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))  # 256 rows at most
    for order in range(2, ORDER):
        before = Window.partitionBy(F.shiftrightunsigned("suffix", 8))
        here = followed[order].withColumn("all", F.sum("n").over(before)).withColumn("kinds", F.count(F.lit(1)).over(before)).withColumn("shorter", F.col("suffix").bitwiseAND(tail(order - 1)))
        less = shared.withColumnsRenamed({"suffix": "shorter", "p": "p_shorter"})
        shared = here.join(less, "shorter").select("suffix", ((F.col("n") - d + d * F.col("kinds") * F.col("p_shorter")) / F.col("all")).alias("p"))

    around = grams.groupBy("context").agg(
        *(F.sum(c).alias(f"{c}_all") for c in ("toxic", "ordinary")), *(F.sum((F.col(c) > 0).cast("bigint")).alias(f"{c}_kinds") for c in ("toxic", "ordinary"))
    )
    joined = (
        grams.join(around, "context")
        .withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (8 * (ORDER - 1))) - 1)))
        .join(shared, "suffix")
    )

    def probability(c: str):
        seen = (F.greatest(F.col(c) - d, F.lit(0.0)) + d * F.col(f"{c}_kinds") * F.col("p")) / F.col(f"{c}_all")
        return F.when(F.col(f"{c}_all") > 0, seen).otherwise(F.col("p"))

    def backoff(c: str):
        return F.when(F.col(f"{c}_all") > 0, d * F.col(f"{c}_kinds") / F.col(f"{c}_all")).otherwise(F.lit(1.0))

    by_gram = joined.select(F.lit(1).alias("kind"), F.col("gram").alias("key"), F.log(probability("toxic") / probability("ordinary")).alias("ratio"), (F.col("toxic") + F.col("ordinary")).alias("weight"))
    by_context = around.select(F.lit(0).alias("kind"), F.col("context").alias("key"), F.log(backoff("toxic") / backoff("ordinary")).alias("ratio"), (F.col("toxic_all") + F.col("ordinary_all")).alias("weight"))
    return by_gram.unionByName(by_context)


_ROW = "place int, kind int, block string, payload binary"
_CONTEXTS, _GRAMS, _ASKED, _TEXTS = range(4)


def _row(place: int, kind: int, block: str | None, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([kind], pa.int32()), pa.array([block], pa.string()), pa.array([payload], pa.binary())], ["place", "kind", "block", "payload"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str | None, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in range(4))


def _packed(keys: np.ndarray, ratios: np.ndarray | None = None) -> bytes:
    """Ascending keys, and their ratios, as bytes: differences byte plane by byte plane, compressed."""
    planes = lambda x: x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    raw = planes(np.diff(keys, prepend=np.uint64(0))) + (b"" if ratios is None else planes(ratios.astype(np.float32)))
    return len(keys).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(payload[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(payload[8:], 12 * n, asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    keys = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(keys, dtype=np.uint64), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view(np.float32).ravel()


def _dealt(kind: int, block: str | None, keys: np.ndarray, ratios: np.ndarray | None, shards: int) -> Iterator[pa.RecordBatch]:
    """Ascending keys by shard. An n-gram goes with its context, so that one shard answers for both."""
    shard = (mix(keys if kind == _CONTEXTS else keys >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    ends = np.cumsum(np.bincount(shard, minlength=shards))
    for place, (start, end) in enumerate(zip(np.append(0, ends[:-1]), ends)):
        if end > start:
            some = order[start:end]
            yield _row(place, kind, block, _packed(keys[some], np.zeros(len(some), np.float32) if ratios is None else ratios[some]))


def _deal_table(shards: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def dealt():
            kind, key, ratio = (np.concatenate([h[c] for h in held]) for c in range(3))
            for k in (_CONTEXTS, _GRAMS):
                here = np.flatnonzero(kind == k)
                here = here[np.argsort(key[here])]
                yield from _dealt(k, None, key[here], ratio[here], shards)

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint64), batch.column(2).to_numpy()))
            size += batch.num_rows
            if size >= SHARD_ROWS:
                yield from dealt()
                held, size = [], 0
        if held:
            yield from dealt()

    return deal


def _blocks(batches: Iterator[pa.RecordBatch], text: int, split: int) -> Iterator[tuple[str, pa.RecordBatch | None]]:
    """(block, piece) in the order of the rows, and (block, None) after its last piece. Blocks are named by the partition of the scan."""
    part, n_blocks, size = None, 0, 0
    for batch in batches:
        if batch.num_rows:
            part = batch.column(split)[0].as_py()
        for first, data, offsets in runs(batch.column(text), PIECE_BYTES):
            yield f"{part}-{n_blocks}", batch.slice(first, len(offsets) - 1)
            size += len(data)
            if size >= BLOCK_BYTES:
                yield f"{part}-{n_blocks}", None
                n_blocks, size = n_blocks + 1, 0
    if part is not None:
        yield f"{part}-{n_blocks}", None


def _ask(text: int, split: int, shards: int):
    """The distinct n-grams of each block of rows by shard."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        coming = 0
        for block, piece in _blocks(batches, text, split):
            if piece is None:
                if held:
                    yield from _dealt(_ASKED, block, _distinct(np.concatenate(held)), None, shards)
                held, coming = [], 0
                continue
            for _, some, places in runs(piece.column(text)):
                gram, whole = _grams(some, places)
                held.append(_distinct(gram[whole]))
                coming += len(held[-1])
                if coming > max(MERGE_GRAMS, len(held[0])):
                    held, coming = [_distinct(np.concatenate(held))], 0

    return ask


def _carry(text: int, split: int):
    """The rows of each block in compressed pieces."""

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, piece in _blocks(batches, text, split):
            if piece is None:
                continue
            piece = pa.RecordBatch.from_arrays([c for i, c in enumerate(piece.columns) if i != split], [n for i, n in enumerate(piece.schema.names) if i != split])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as out:
                out.write_batch(piece)
            yield _row(0, _TEXTS, block, sink.getvalue().to_pybytes())

    return carry


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ascending keys hold what is wanted, and whether they do."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard, its table first: every n-gram asked for gets its own ratio, that of its context if it was never counted, or else 0."""
    here, table, ready = None, {}, False
    for place, kind, block, payload in _rows(batches):
        if place != here:
            here, table, ready = place, {_CONTEXTS: [], _GRAMS: []}, False
        if kind != _ASKED:
            table[kind].append(_unpacked(payload))
            continue
        if not ready:
            for k, pieces in table.items():
                keys, ratios = (np.concatenate([p[c] for p in pieces]) if pieces else np.zeros(0, (np.uint64, np.float32)[c]) for c in range(2))
                order = np.argsort(keys)
                table[k] = keys[order], ratios[order]
            ready = True
        grams, ratio = _unpacked(payload)
        ratio = np.zeros(len(grams), np.float32)
        for k, keys in ((_CONTEXTS, grams >> np.uint64(8)), (_GRAMS, grams)):
            at, known = _at(table[k][0], keys)
            ratio[known] = table[k][1][at[known]]
        yield _row(place, kind, block, _packed(grams, ratio))


N_FEATURES = 2 + len(STRETCHES)


def _features(data: np.ndarray, offsets: np.ndarray, answers) -> np.ndarray:
    """Per text: the mean log ratio per character, log length, and the best mean over stretches of words."""
    grams, ratios = answers
    n_texts = len(offsets) - 1
    out = np.zeros((n_texts, N_FEATURES))
    sizes = np.diff(offsets)
    out[:, 1] = np.log1p(sizes)
    if not len(data):
        return out
    gram, whole = _grams(data, offsets)
    names, back = np.unique(gram[whole], return_inverse=True)
    at, known = _at(grams, names)
    if not known.all():
        raise RuntimeError("two scans of the same rows found different partitions: n-grams of a block were not looked up")
    ratio = np.zeros(len(data))
    if len(names):
        ratio[whole] = ratios[at][back]
    total = np.zeros(len(data) + 1)
    np.cumsum(ratio, out=total[1:])
    out[:, 0] = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(sizes, 1)
    inside = ~_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][sizes > 0]] = False
    starts = np.flatnonzero(inside & ~before)
    text = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), offsets[text + 1])  # a word goes with the white space after it
    for i, n in enumerate(STRETCHES):
        # stretches of n words that end within the text; shorter texts count as one stretch of fixed length
        last = np.minimum(np.arange(len(starts)) + n - 1, len(starts) - 1)
        last = np.minimum(last, np.searchsorted(text, text, "right") - 1)
        mean = (total[ends[last]] - total[starts]) / np.maximum(ends[last] - starts, 6 * n)
        np.maximum.at(out[:, 2 + i], text, mean)
    return out


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps on standardised features: (centre, scale, weights with the constant last).

    The constant is drawn towards `PRIOR`, so that a handful of rows does not speak against every text. With rows of one class only, or
    none, nothing is known against a text: every score is 0 but for rounding.
    """
    if not len(x) or y.min() == y.max():
        return np.zeros(N_FEATURES), np.ones(N_FEATURES), np.append(np.zeros(N_FEATURES), -30.0)
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), LEAST_DEVIATION)
    z = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    prior = np.append(np.zeros(N_FEATURES), PRIOR)
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - RIDGE * (w - prior)
        curve = (z * (p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    return centre, scale, w


def _score(fitted, text: int, name: str):
    """Answers and pieces of rows, by block, to the rows, whose column `text` is the text, and a score (or, not fitted, the features)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, pieces, answers = None, [], None
        for _, kind, block, payload in _rows(batches):
            if block != here:
                here, pieces, answers = block, [], None
            if kind == _ASKED:
                pieces.append(_unpacked(payload))
                continue
            if answers is None:
                keys, ratios = (np.concatenate([p[c] for p in pieces]) if pieces else np.zeros(0, (np.uint64, np.float32)[c]) for c in range(2))
                order = np.argsort(keys)
                answers = keys[order], ratios[order]
            batch = pa.ipc.open_stream(payload).read_next_batch()
            for first, data, offsets in runs(batch.column(text)):
                x = _features(data, offsets, answers)
                rest = batch.slice(first, len(offsets) - 1)
                if fitted is None:
                    yield rest.append_column(name, pa.array(list(x), pa.list_(pa.float64())))
                else:
                    centre, scale, w = fitted
                    z = np.clip(((x - centre) / scale) @ w[:-1] + w[-1], -30, 30)
                    yield rest.append_column(name, pa.array(1 / (1 + np.exp(-z))))

    return score


def _looked_up(rows: DataFrame, text: str, ratios: DataFrame, fitted, name: str) -> DataFrame:
    """`rows` with a score (or, not fitted, the features) as column `name`, by the exact table of ratios (kind, key, ratio).

    Blocks of rows ask for each of their distinct n-grams once. The questions meet the table shard by shard, and the answers meet the
    rows block by block: no task holds more than a shard or a block, and a common n-gram is asked for once a block. Only questions go to
    the shards; the rows, scanned again, go to their blocks. Both scans must deal rows to partitions alike, as those of files and
    checkpoints do; anything else is written first.
    """
    if "Exchange" in rows._jdf.queryExecution().sparkPlan().toString() or "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = cut_lineage(rows)
    shards = max(LEAST_SHARDS, -(-ratios.count() // SHARD_ROWS))
    at = rows.columns.index(text)
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    split = len(rows.columns)
    dealt = rows.withColumn(free_name(rows, "__split"), F.spark_partition_id())
    asked = ratios.mapInArrow(_deal_table(shards), _ROW).unionByName(dealt.mapInArrow(_ask(at, split, shards), _ROW))
    answered = asked.repartition("place").sortWithinPartitions("place", "kind").mapInArrow(_answer, _ROW)
    both = answered.unionByName(dealt.mapInArrow(_carry(at, split), _ROW))
    return both.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_score(fitted, at, name), f"{others}, `{name}` {'array<double>' if fitted is None else 'double'}")


class ToxicityModel:
    """A fitted scorer; `score` adds a column to any table with a text column."""

    def __init__(self, ratios: DataFrame, fitted):
        self.ratios, self.fitted = ratios, fitted

    def score(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """All columns of `docs`, the text too, and the score; whole texts. Null and empty texts get the score of an empty text.

        A column that already has the name of the score is replaced.
        """
        return _looked_up(docs.drop(name), text, self.ratios, self.fitted, name)


def _table(ratios: DataFrame) -> DataFrame:
    """One row for every n-gram and context counted."""
    return cut_lineage(ratios.select("kind", "key", F.col("ratio").cast("float").alias("ratio")))


def train(labelled: DataFrame, text: str = "text", toxic: str = "toxic", key: str = "doc_id") -> ToxicityModel:
    """Learn from every row of `labelled` with a label; counts cover all of them, the calibration a bounded sample (by hash of the key).

    Rows with a null key, label or text teach nothing. Unless both the counted rows and the calibration have both classes, every score is 0 but for rounding.
    """
    spark = labelled.sparkSession
    hashed = F.xxhash64(F.col(key).cast("string"))
    # n-grams of one part score the other part for the calibration, so that it sees texts the counts do not hold
    held = F.pmod(hashed, F.lit(4)) == 0
    usable = labelled.filter(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(toxic).isNotNull())
    group = F.when(held, F.lit(2)).otherwise(F.lit(0)) + (F.col(toxic) == 1).cast("int")
    partial = usable.select(F.col(text).alias("text"), group.alias("part")).mapInArrow(_count, "gram bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))
    counts = cut_lineage(partial.groupBy("gram").agg(*(F.sum(c).alias(c) for c in COUNTS)))
    release_shuffles(spark)  # here and below: what a step exchanged is not kept on disk through the next one
    part = counts.filter("ordinary_a + toxic_a > 0").select("gram", F.col("toxic_a").alias("toxic"), F.col("ordinary_a").alias("ordinary"))
    first = _table(log_ratios(part))
    release_shuffles(spark)
    size = usable.select(key).filter(held).count()
    share = min(1.0, CALIBRATION_ROWS / max(size, 1))
    sample = usable.filter(held & (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("calibration")), F.lit(1_000_000)) < int(share * 1_000_000)))
    seen = _looked_up(sample.select((F.col(toxic) == 1).alias("toxic"), F.col(text).alias("text")), "text", first, None, "features").select("toxic", "features").toArrow()
    x = np.array(seen.column("features").combine_chunks().flatten().to_numpy(), float).reshape(-1, N_FEATURES)
    y = seen.column("toxic").to_numpy().astype(float)
    known = part.agg(F.max("toxic"), F.max("ordinary")).first()
    fitted = _fit(x, y) if known[0] and known[1] else _fit(x[:0], y[:0])
    del first, part, sample
    release_shuffles(spark)
    both = counts.select("gram", (F.col("toxic_a") + F.col("toxic_b")).alias("toxic"), (F.col("ordinary_a") + F.col("ordinary_b")).alias("ordinary"))
    ratios = _table(log_ratios(both))
    del both, counts
    release_shuffles(spark)  # before texts are dealt again
    return ToxicityModel(ratios, fitted)


def is_held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def likely_labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id may be in `labels`: all that are, and few others. An exact join must follow.

    Texts without a label need not be shuffled for it. Ids are marked in a bitmap of bounded size; with more ids than it has bits
    for, more texts pass.
    """
    if docs.schema["doc_id"].dataType != labels.schema["doc_id"].dataType:
        return docs  # equal ids of different types have different hashes
    blocks = min(max(-(-labels.count() * BITS_PER_ID // BLOCK_BITS), 1), MOST_BLOCKS)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(blocks * BLOCK_BITS))
    block, bit = F.floor(place / BLOCK_BITS), place % BLOCK_BITS
    marks = labels.groupBy(block.alias("__block")).agg(F.bitmap_construct_agg(bit).alias("__marks"))
    byte = F.conv(F.hex(F.expr("substring(__marks, cast(__bit div 8 as int) + 1, 1)")), 16, 10).cast("bigint")
    met = docs.withColumns({"__block": block, "__bit": bit}).join(F.broadcast(marks), "__block")
    return met.filter(F.getbit(byte, F.col("__bit") % 8) == 1).select(*docs.columns)


def train_on_labels(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Train on the labelled documents outside the held-out quarter. A document with several labels teaches all of them."""
    open_docs = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & ~is_held_out())
    open_labels = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out())
    return train(likely_labelled(open_docs, open_labels).join(open_labels.hint("merge"), "doc_id"))  # labels grow with the documents: one way to join at every size


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every document. A null doc_id is held out of training and reported as not held out."""
    model = train_on_labels(docs, labels)
    scored = model.score(docs.select("doc_id", "text"))
    return scored.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` whose score stays below the threshold, with all their columns, whatever they are called.

    With labels too few to learn from all rows stay; a null text is scored as an empty one; no rows give no rows; repeated rows are rows.
    """
    name = free_name(docs, "__toxicity")
    return train_on_labels(docs, labels).score(docs, name=name).filter(F.col(name) < threshold).select(*docs.columns)
