"""Near-duplicates by BagMinHash.

A text is the multiset of its five-word shingles. Every shingle runs Poisson processes over its weight, cut at whole numbers and at powers
of two; the earliest point that falls into a signature slot below the shingle's weight is the slot's value. Two texts agree in a slot with
the probability of their weighted Jaccard similarity. Slots are banded, and what shares a band is verified on exact multiset overlap.

Within a bucket, texts are first compared with a leader, so links grow with the texts and not with their square. Where a bucket then still
holds several classes, its signatures meet in blocks inside tasks, which name the rows that have a partner of another class whose signature
allows the similarity. The texts of these rows meet in the same blocks, where every such pair is verified and a forest of the links leaves
the task: what is sent grows with the rows of a block and not with its pairs, and no link is lost to the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cinelake.llm.registry import release_shuffles
from cinelake.llm.texts import Spans, Words, mix, runs, shielded
from cinelake.operators.components import connected_components
from cinelake.session import cut_lineage

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Pairs at the least similarity agree in 102 of 128 slots on average; fewer than these happen once in 30,000 of them.
LEAST_SLOTS = 84
_RUN, _PER_SALT, _BLOCK = 2 << 20, 256, 1024
LEADER_ROUNDS = 1
#: Shingles of the texts of a block, unless one text has more.
_BLOCK_SHINGLES = 1 << 20
#: Elements that at most so many texts of a block share are counted pair by pair, others as columns of a product.
_RARE, _COLUMNS = 8, 2048
_GOLD, _ALL = 0x9E3779B97F4A7C15, 2**64 - 1


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of the distinct shingles of a run of texts, ordered by text and hash."""
    words = Words(data, offsets)
    hashes = Spans(words.hashes).windows(SHINGLE)
    text = words.text[: len(hashes)]
    whole = words.text[SHINGLE - 1 :][: len(hashes)] == text
    hashes, text = hashes[whole], text[whole]
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    return text[at], hashes[at], np.diff(np.append(at, len(hashes)))


def signatures(text: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_texts: int) -> np.ndarray:
    """BagMinHash values, n_texts x SLOTS (infinite for texts without shingles)."""
    low, length = np.zeros(len(hashes), np.int64), np.ones(len(hashes), np.int64)
    element = np.arange(len(hashes))
    parts = [(element, low, length)]
    top = 1
    while (more := np.flatnonzero(weights > top)).size:  # (1, 2], (2, 4], (4, 8], ... as far as the weight reaches
        parts.append((more, np.full(len(more), top), np.full(len(more), top)))
        top *= 2
    element, low, length = (np.concatenate(p) for p in zip(*parts))
    seed = mix(hashes[element] ^ mix(low.astype(np.uint64) + np.uint64(7)))
    owner, weight = text[element], weights[element]
    time = np.zeros(len(element))
    best = np.full(n_texts * SLOTS, np.inf)
    most = np.full(n_texts, np.inf)
    point = 0
    while len(seed):
        point += 3
        gap, place = (mix(seed + np.uint64(p * _GOLD & _ALL)) for p in (point, point + 1))
        time = time - np.log1p(-(gap >> np.uint64(11)).astype(np.float64) / 2**53) / length
        slot = (place & np.uint64(SLOTS - 1)).astype(np.int64)
        level = low + 1 + ((place >> np.uint64(32)).astype(np.int64) * length >> 32)
        inside = level <= weight
        np.minimum.at(best, (owner * SLOTS + slot)[inside], time[inside])
        most = best.reshape(n_texts, SLOTS).max(axis=1)
        alive = time < most[owner]
        if not alive.all():
            seed, owner, weight, low, length, time = (v[alive] for v in (seed, owner, weight, low, length, time))
    return best.reshape(n_texts, SLOTS)


def _banded(values: np.ndarray) -> np.ndarray:
    bits = values.view(np.uint64).reshape(len(values), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bits.shape[:2])
    for i in range(ROWS):
        key = mix(key * np.uint64(_GOLD) ^ bits[:, :, i])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        others = batch.remove_column(batch.num_columns - 1)
        for first, data, offsets in runs(batch.column(batch.num_columns - 1), _RUN):
            n = len(offsets) - 1
            text, hashes, weights = shingles(data, offsets)
            size = np.bincount(text, weights=weights, minlength=n).astype(np.int64)
            values = signatures(text, hashes, weights, n)
            bands, prints = _banded(values), (mix(values.view(np.uint64)) >> np.uint64(48)).astype("<u2")
            prints = np.hstack([prints, bands.astype("<u4").view("<u2")])  # 16 bits of every slot, then 32 of every band
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            yield others.slice(first, n).append_column("size", pa.array(size)).append_column("bands", lists).append_column("print", pa.array([p.tobytes() for p in prints], pa.binary()))


def _node(text: Column) -> Column:
    """One number for equal texts (60 bits of a digest); null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _overlaps(threshold: float):
    """Stream (leader, salt, kind, node, text): each leader's text, then its members'; yield the pairs that are similar enough."""

    def bags(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for first, data, offsets in runs(column, _RUN):
            text, hashes, weights = shingles(data, offsets)
            bounds = np.searchsorted(text, np.arange(len(offsets)))
            for i in range(len(offsets) - 1):
                yield first + i, hashes[bounds[i] : bounds[i + 1]], weights[bounds[i] : bounds[i + 1]]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = hashes = weights = None
        for batch in batches:
            names, kinds, nodes = (batch.column(i).to_numpy() for i in (0, 1, 2))
            a, b = [], []
            for i, h, w in bags(batch.column(3)):
                if kinds[i] == 0:
                    leader, hashes, weights = names[i], h, w
                elif leader == names[i] and len(h) and len(hashes):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    both = np.minimum(weights[at], w)[hashes[at] == h].sum()
                    if both >= threshold * (weights.sum() + w.sum() - both):
                        a.append(leader)
                        b.append(nodes[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return verify


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of `pairs` whose exact multiset overlap reaches the threshold. A leader with many members is dealt to several tasks."""
    salts = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / _PER_SALT) + 1).alias("salts"))
    members = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b", F.lit("salt")), F.col("salts")).alias("salt"), F.col("b").alias("node")).join(texts, "node")
    leaders = salts.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt")).join(texts, "node")
    rows = members.select("a", "salt", F.lit(1).alias("kind"), "node", "text").unionByName(leaders.select(F.col("node").alias("a"), "salt", F.lit(0).alias("kind"), "node", "text"))
    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    return dealt.select("a", "kind", "node", "text").mapInArrow(_overlaps(threshold), "a bigint, b bigint")


def _sized_alike(a: Column, b: Column, threshold: float) -> Column:
    return F.least(a, b) >= threshold * F.greatest(a, b)


def _leader_pairs(buckets: DataFrame, threshold: float, order: int) -> DataFrame:
    """(a, b): every text of a bucket with the bucket's leader, if it is of another class and their sizes allow the similarity."""
    place = F.xxhash64("node", F.lit(order))  # one order for all bands, so that a group's bands mostly share their leader
    leader = F.min_by(F.struct("node", "class", "size"), place).alias("leader")
    led = buckets.groupBy("bucket").agg(leader)
    met = buckets.join(led, "bucket").filter(F.col("leader.class") != F.col("class"))
    return met.filter(_sized_alike(F.col("leader.size"), F.col("size"), threshold)).select(F.col("leader.node").alias("a"), F.col("node").alias("b")).distinct()


def _forest(a: np.ndarray, b: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Of the links (a, b), the places of those that join classes `kind` not joined by earlier ones."""
    root = {k: k for k in np.unique(kind).tolist()}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    left, chosen = np.arange(len(a)), []
    while len(left):
        for i in left[:4096].tolist():
            x, y = find(int(kind[a[i]])), find(int(kind[b[i]]))
            if x != y:
                root[x] = y
                chosen.append(i)
        names, at = np.unique(kind, return_inverse=True)
        now = np.array([find(k) for k in names.tolist()])[at]
        left = left[4096:]
        left = left[now[a[left]] != now[b[left]]]
    return np.array(chosen, np.int64)


def _common(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Exact multiset overlaps of all pairs of texts, each given by its (hashes, weights).

    A shingle of weight w is w elements, (shingle, 1) to (shingle, w): the overlap of multisets is the number of common elements.
    """
    n = len(texts)
    weights = np.concatenate([w for _, w in texts]).astype(np.int64)
    ends = np.cumsum(weights)
    level = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - weights, weights)
    owner = np.repeat(np.repeat(np.arange(n), [len(h) for h, _ in texts]), weights)
    element = np.repeat(np.concatenate([h for h, _ in texts]), weights)
    order = np.lexsort((owner, level, element))
    owner, level, element = owner[order], level[order], element[order]
    new = np.ones(len(owner), bool)
    new[1:] = (element[1:] != element[:-1]) | (level[1:] != level[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(owner)))
    out = np.zeros(n * n, np.int64)
    for c in range(2, _RARE + 1):
        first = at[count == c]
        if len(first):
            pairs = [owner[first + j] * n + owner[first + i] for i in range(c) for j in range(i)]
            out += np.bincount(np.concatenate(pairs), minlength=n * n)
    out = out.reshape(n, n)
    frequent = np.flatnonzero(count > _RARE)
    for i in range(0, len(frequent), _COLUMNS):
        some = frequent[i : i + _COLUMNS]
        column = np.repeat(np.arange(len(some)), count[some])
        place = np.repeat(at[some] - np.cumsum(count[some]) + count[some], count[some]) + np.arange(len(column))
        held = np.zeros((n, len(some)), np.float32)
        held[owner[place], column] = 1
        out += np.triu(held @ held.T, 1).astype(np.int64)
    return out + out.T


def _may_link(kind: np.ndarray, size: np.ndarray, own: np.ndarray, bands: np.ndarray, slots: np.ndarray, block: tuple, threshold: float):
    """(a, b) of the block's pairs of different classes that this block decides: signatures and sizes allow the similarity, and no earlier
    band is shared, so that a pair is decided in one block only."""
    bucket, i, j = block
    band = int(np.flatnonzero(bands[0] == bucket % 2**32)[0])
    step = max(1, (32 << 20) // (len(kind) * SLOTS))
    for first in range(0, len(kind), step):
        agreed = (slots[first : first + step, None, :] == slots[None, :, :]).sum(axis=2, dtype=np.int16)
        a, b = np.nonzero(agreed >= LEAST_SLOTS)
        a += first
        good = (a < b) & (kind[a] != kind[b]) & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]))
        if i != j:
            good &= own[a] != own[b]
        a, b = a[good], b[good]
        for part in range(0, len(a), 1 << 18):
            x, y = a[part : part + (1 << 18)], b[part : part + (1 << 18)]
            here = ~(bands[x, :band] == bands[y, :band]).any(axis=1)
            yield x[here], y[here]


def _blocks(batches: Iterator[pa.RecordBatch], rows_of) -> Iterator[tuple[tuple, list[tuple]]]:
    """(bucket, i, j) and the rows of each block, from a stream in order."""
    held: list[tuple] = []
    block = None
    for batch in batches:
        for key, row in rows_of(batch):
            if key != block:
                if len(held) > 1:
                    yield block, held
                block, held = key, []
            held.append(row)
    if len(held) > 1:
        yield block, held


def _signed_rows(batch: pa.RecordBatch) -> Iterator[tuple[tuple, tuple]]:
    for row in zip(*(batch.column(c).to_pylist() for c in range(8))):
        yield row[:3], row[3:]


def _arrays(held: list[tuple]):
    node, kind, size, own = (np.array(c) for c in zip(*(h[:4] for h in held)))
    prints = np.frombuffer(b"".join(h[4] for h in held), "<u2").reshape(len(held), -1)
    return node, kind, size, own, prints[:, SLOTS:].copy().view("<u4"), prints[:, :SLOTS]


def _partnered(threshold: float):
    """Stream signed rows of blocks in order; pass on the rows that have a pair to be verified in their block."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _blocks(batches, _signed_rows):
            node, kind, size, own, bands, slots = _arrays(held)
            met = np.zeros(len(node), bool)
            for a, b in _may_link(kind, size, own, bands, slots, block, threshold):
                met[a] = met[b] = True
            if met.any():
                n = int(met.sum())
                keys = [pa.array(np.full(n, k), pa.int64()) for k in block]
                yield pa.RecordBatch.from_arrays(keys + [pa.array(node[met], pa.int64())], ["bucket", "i", "j", "node"])

    return find


def _linked(threshold: float):
    """Stream signed rows with their texts, block by block; verify the pairs and pass on a forest of the links."""

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple, tuple]]:
        signed = _signed_rows(batch)
        for _, data, offsets in runs(batch.column(8), _RUN):
            text, hashes, weights = shingles(data, offsets)
            bounds = np.searchsorted(text, np.arange(len(offsets)))
            for k in range(len(offsets) - 1):
                key, row = next(signed)
                yield key, (*row, hashes[bounds[k] : bounds[k + 1]].copy(), weights[bounds[k] : bounds[k + 1]].copy())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _blocks(batches, rows_of):
            node, kind, size, own, bands, slots = _arrays(held)
            both = _common([h[5:7] for h in held])
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in _may_link(kind, size, own, bands, slots, block, threshold):
                good = both[x, y] >= threshold * (size[x] + size[y] - both[x, y])
                a.append(x[good])
                b.append(y[good])
                x, y = np.concatenate(a), np.concatenate(b)
                kept = _forest(x, y, kind)
                a, b = [x[kept]], [y[kept]]
            x, y = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(node[x], pa.int64()), pa.array(node[y], pa.int64())], ["a", "b"])

    return verify


def _block_links(buckets: DataFrame, signed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Verified links across classes in the buckets that still hold several, a forest of them from each block of rows."""
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    rows = buckets.join(sizes, "bucket").join(signed.select("node", "print"), "node")
    n_blocks = F.floor(F.greatest(F.col("n") / _BLOCK, F.least("n", F.col("shingles") / _BLOCK_SHINGLES))) + 1
    own = F.pmod(F.xxhash64("node", F.lit("block")), n_blocks)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "class", "size", "own", "print")
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    met = cut_lineage(dealt.mapInArrow(_partnered(threshold), "bucket bigint, i bigint, j bigint, node bigint"))
    again = rows.join(met, ["bucket", "i", "j", "node"]).join(texts, "node")
    again = again.select(*rows.columns, "text").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    return again.mapInArrow(_linked(threshold), "a bigint, b bigint")


def _open(buckets: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one class."""
    several = buckets.groupBy("bucket").agg(F.min("class").alias("least"), F.max("class").alias("most")).filter("least <> most").select("bucket")
    return cut_lineage(buckets.join(several, "bucket"))


def _classes(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From rows of doc_id, text and node: (doc_id, node) of every row, (node, found) of linked texts, and the verified links (a, b)."""
    signed = cut_lineage(rows.select("doc_id", "node", "text").mapInArrow(_sign, "doc_id bigint, node bigint, size bigint, bands array<bigint>, print binary"))
    firsts = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    # one row of a text stands for all of them: sizes, bands and prints follow from the text
    single = cut_lineage(signed.filter("size > 0").drop("doc_id").dropDuplicates(["node"]))
    buckets = _open(single.select("node", "size", F.col("node").alias("class"), F.explode("bands").alias("bucket")))
    wanted = buckets.select("node").distinct().join(firsts, "node")
    l, r = rows.select("node", "doc_id", "text").alias("l"), wanted.alias("r")  # noqa: E741
    same = (F.col("l.node") == F.col("r.node")) & F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
    texts = cut_lineage(l.join(r, same).select("l.node", "l.text").dropDuplicates(["node"]))

    release_shuffles(rows.sparkSession)
    links = classes = None
    steps = [lambda: _verified(_leader_pairs(buckets, threshold, 0), texts, threshold)] * LEADER_ROUNDS
    for step in (*steps, lambda: _block_links(buckets, single, texts, threshold)):
        if classes is not None:
            buckets = _open(buckets.drop("class").join(classes, "node", "left").withColumn("class", F.coalesce("found", "node")).drop("found"))
        fresh = cut_lineage(step())
        links = fresh if links is None else links.unionByName(fresh)
        classes = connected_components(links, "a", "b").withColumnRenamed("component", "found")
        release_shuffles(rows.sparkSession)
    return signed.select("doc_id", "node"), classes, links


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest id of its class) and n_links for every row of `docs`.

    Two texts are linked if the multisets of their five-word shingles have a weighted Jaccard similarity of at least `threshold`; classes
    are the connected components. Equal texts are one class whatever their length, also empty ones (null counts as empty); texts of fewer
    than five words have no other links. n_links counts the verified links of the row's text to other texts that were needed to build
    its class, not all that exist. Rows with a null id belong to the class of their text; a class of such rows only has class_id null.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("node", _node(F.col("text")))
    named, classes, links = _classes(rows, threshold)
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    placed = named.join(classes, "node", "left").join(degrees, "node", "left").withColumn("class", F.coalesce("found", "node"))
    placed = placed.select("doc_id", "class", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    names = placed.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return placed.join(names, "class").select("doc_id", "class_id", "n_links")


def keep_one_of_each(docs: DataFrame, threshold: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every near-duplicate class, with all its columns, whatever they are called: the one with the smallest id (null last, then by text).

    Rows whose ids are all null are linked like others; of repeated rows one stays; a null text counts as empty; no rows give no rows.
    """
    names = docs.columns
    docs = shielded(docs)
    rows = docs.withColumn("__node", _node(F.col(text).cast("string"))).withColumn("__id", F.col(doc_id).cast("bigint"))
    named, classes, _ = _classes(rows.select(F.col("__id").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col("__node").alias("node")), threshold)
    placed = named.join(classes, "node", "left").select("doc_id", "node", F.coalesce("found", "node").alias("class"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("best")
    kept = placed.groupBy("class").agg(best).select(F.col("best.node").alias("__node"), F.col("best.doc_id").alias("__kept"))
    met = rows.join(kept, "__node").filter(F.col("__id").eqNullSafe(F.col("__kept")))
    return met.dropDuplicates(["__node"]).select(*docs.columns).toDF(*names)
