"""Windows that occur twice in a collection of texts, found exactly and without moving whole texts around.

Every window of `width` units picks an anchor, the least of the hashed `gram`-unit strings inside it. Equal windows pick the same anchor at
the same place, so a window needs to be compared only with windows that have an equal anchor. Consecutive windows with one anchor form a
segment; a text is a few segments per `width` units. Segments found twice are settled by counting. Only where segments with an equal anchor
differ is their content fetched, one copy of each, and given to a resolver (a suffix automaton, a column-wise order) class by class; classes
with more than `MOST_IN_CLASS` different segments are split first, by longer strings that their windows share and at last into single windows,
so no task sees a large class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cinelake.llm.registry import release_shuffles
from cinelake.llm.texts import Spans, Words, byte_values, cover, least_positions, mix, runs
from cinelake.session import cut_lineage

MOST_IN_CLASS = 200
PARTS = 8


class ByWords:
    """Texts as the words `[^\\x20\\x09-\\x0D]+`."""

    joint = b" "

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets)
        self.data, self.starts, self.ends, self.values, self.bounds = data, words.starts, words.ends, words.hashes, words.bounds

    def content(self, first: int, last: int) -> bytes:
        return self.data[self.starts[first] : self.ends[last - 1]].tobytes() if last > first else b""

    def kept(self, first: int, last: int, keep: np.ndarray) -> bytes:
        """The kept words of units first .. last - 1, joined by one space."""
        return b" ".join([self.data[a:b].tobytes() for a, b in zip(self.starts[first:last][keep], self.ends[first:last][keep])])


class ByBytes:
    """Texts as their UTF-8 bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.values, self.bounds = data, byte_values(data), offsets

    def content(self, first: int, last: int) -> bytes:
        return self.data[first:last].tobytes()

    def kept(self, first: int, last: int, keep: np.ndarray) -> bytes:
        return self.data[first:last][keep].tobytes()


@dataclass(frozen=True)
class Windows:
    """What is compared: the units, the window's width, the anchor's size, and how a class of segments is settled."""

    units: type
    width: int
    gram: int
    resolver: Callable


class Segments:
    """The segments of a run of texts: text, first window, windows, place of the anchor in the segment, anchor and segment hashes."""

    def __init__(self, kind: Windows, units):
        spans = Spans(units.values)
        grams = spans.windows(kind.gram)
        anchor = least_positions(grams, kind.width - kind.gram + 1)
        place = np.arange(len(anchor))
        text = np.searchsorted(units.bounds, place, "right") - 1
        whole = place + kind.width <= units.bounds[text + 1]
        place, anchor, text = place[whole], anchor[whole], text[whole]
        new = np.ones(len(place), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)
        at = np.flatnonzero(new)
        self.start, self.text, self.windows = place[at], text[at], np.diff(np.append(at, len(place)))
        self.offset = anchor[at] - self.start
        self.key = grams[anchor[at]].view(np.int64)
        self.hash = spans.of(self.start, self.start + self.windows + kind.width - 1).view(np.int64)
        self.spans = spans


def node_of(text: Column) -> Column:
    """One number for equal texts (60 bits of a digest)."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _list(values: np.ndarray, bounds: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


_SEGMENTS = "node bigint, keys array<bigint>, hashes array<bigint>, times array<int>, starts array<int>, windows array<int>, offsets array<int>"


def _sign(kind: Windows):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in runs(batch.column(1)):
                units = kind.units(data, offsets)
                s = Segments(kind, units)
                # a segment that its text holds several times is listed once
                order = np.lexsort((s.hash, s.text))
                new = np.ones(len(order), bool)
                new[1:] = (s.hash[order][1:] != s.hash[order][:-1]) | (s.text[order][1:] != s.text[order][:-1])
                at = np.flatnonzero(new)
                pick, times = order[at], np.diff(np.append(at, len(order)))
                bounds = np.searchsorted(s.text[pick], np.arange(len(offsets)))
                start = s.start[pick] - units.bounds[s.text[pick]]
                columns = [batch.column(0).slice(first, len(offsets) - 1), _list(s.key[pick], bounds, pa.int64()), _list(s.hash[pick], bounds, pa.int64())]
                columns += [_list(c.astype(np.int32), bounds, pa.int32()) for c in (times, start, s.windows[pick], s.offset[pick])]
                yield pa.RecordBatch.from_arrays(columns, ["node", "keys", "hashes", "times", "starts", "windows", "offsets"])

    return sign


_CONTENT = "key bigint, hash bigint, weight bigint, offset int, content binary, parent_key bigint, parent_hash bigint, base int, windows int"
_CONTENT_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
_NAMES = ("key", "hash", "weight", "offset", "content", "parent_key", "parent_hash", "base", "windows")


def _fetch(kind: Windows):
    """From (text, list of wanted segments): their content. Segments of large classes come in parts, in classes of what a part's windows all hold."""
    step = max(1, (kind.width - kind.gram + 1) // PARTS)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            for first, data, offsets in runs(batch.column(0)):
                units = kind.units(data, offsets)
                spans = None
                rows = []
                for i in range(len(offsets) - 1):
                    base = int(units.bounds[i])
                    for w in wanted[first + i]:
                        start, n, anchor = base + w["start"], w["windows"], base + w["start"] + w["offset"]
                        if not w["large"]:
                            rows.append((w["key"], w["hash"], w["weight"], w["offset"], units.content(start, start + n + kind.width - 1), None, None, None, n))
                            continue
                        spans = spans or Spans(units.values)
                        for part in range((w["offset"] - n + 1) // step, w["offset"] // step + 1):
                            # the windows that begin step * part to step * (part + 1) - 1 before the anchor, and what they have in common
                            lo, hi = max(start, anchor - step * (part + 1) + 1), min(start + n, anchor - step * part + 1)
                            ends = np.array([[anchor - step * part, anchor - step * (part + 1) + 1 + kind.width], [lo, hi + kind.width - 1]])
                            core, own = spans.of(ends[:, 0], ends[:, 1])
                            key = int((mix(core[None] ^ np.uint64(part + 1))).view(np.int64)[0])
                            rows.append((key, int(own.view(np.int64)), w["weight"], anchor - lo, units.content(lo, hi + kind.width - 1), w["key"], w["hash"], lo - start, hi - lo))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _CONTENT_KINDS)], list(_NAMES))

    return fetch


def _windows(kind: Windows):
    """From (key, hash, weight, content): the hash of every window."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in runs(batch.column(3)):
                units = kind.units(data, offsets)
                hashes = Spans(units.values).windows(kind.width)
                at = np.arange(len(hashes))
                text = np.searchsorted(units.bounds, at, "right") - 1
                whole = at + kind.width <= units.bounds[text + 1]
                at, text = at[whole], text[whole]
                columns = [batch.column(c).slice(first, len(offsets) - 1).take(pa.array(text)) for c in range(3)]
                columns += [pa.array(hashes[at].view(np.int64)), pa.array((at - units.bounds[text]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "hash", "weight", "window_hash", "window"])

    return windows


_BATCH_SEGMENTS = 8192


def _settle(kind: Windows):
    """Stream segments ordered by class; whole classes are gathered up to `_BATCH_SEGMENTS` segments and given to the resolver."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hashes, offsets, contents = [], [], [], []

        def answer():
            found = kind.resolver(np.array(keys), np.array(offsets), contents, kind.width)
            rows = [(k, h, w) for k, h, w in zip(keys, hashes, found) if len(w)]
            keys.clear(), hashes.clear(), offsets.clear(), contents.clear()
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["key", "hash", "repeated"]
                )

        for batch in batches:
            for key, hash_, offset, content in zip(*(c.to_pylist() for c in batch.columns)):
                if keys and keys[-1] == key and hashes[-1] == hash_:
                    continue  # the same segment, fetched from a repeated row
                if len(keys) >= _BATCH_SEGMENTS and keys[-1] != key:
                    yield from answer()
                keys.append(key), hashes.append(hash_), offsets.append(offset), contents.append(content)
        if keys:
            yield from answer()

    return settle


def _apply(kind: Windows):
    """Texts with what is known of their segments: counts, removed units and the digest of what is kept."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, known = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_pylist()
            for first, data, offsets in runs(batch.column(1)):
                units = kind.units(data, offsets)
                n_texts = len(offsets) - 1
                segments = None
                rows = []
                for i in range(n_texts):
                    lo, hi = int(units.bounds[i]), int(units.bounds[i + 1])
                    keep = np.ones(hi - lo, bool)
                    if copies[first + i] and hi - lo >= kind.width:
                        keep[:] = False
                    elif known[first + i]:
                        if segments is None:
                            segments = Segments(kind, units)
                            bounds = np.searchsorted(segments.text, np.arange(n_texts + 1))
                        verdicts = {v["hash"]: v["repeated"] for v in known[first + i]}
                        starts = []
                        for s in range(bounds[i], bounds[i + 1]):
                            if (h := int(segments.hash[s])) in verdicts:
                                at = int(segments.start[s]) - lo
                                w = verdicts[h]
                                starts.append(np.arange(at, at + segments.windows[s]) if w is None else at + np.asarray(w, np.int64))
                        if starts:
                            keep = ~cover(np.concatenate(starts), kind.width, hi - lo)
                    edges = np.diff(np.concatenate([[True], keep]).astype(np.int8))
                    rows.append((hi - lo, int((~keep).sum()), int((edges == -1).sum()), hashlib.sha256(units.kept(lo, hi, keep)).hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                columns = [batch.column(0).slice(first, n_texts), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256"])

    return apply


def repeated_segments(rows: DataFrame, kind: Windows) -> tuple[DataFrame, DataFrame]:
    """(node, known) with the repeated segments of each text, and (node, copies) for texts that occur more than once.

    `rows` holds node, doc_id and text. known is an array of (hash, repeated): the windows of the segment that occur elsewhere, null for all.
    """
    signed = cut_lineage(rows.select("node", "text").mapInArrow(_sign(kind), _SEGMENTS).withColumn("row", F.monotonically_increasing_id()))
    firsts = signed.groupBy("node").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"))
    zipped = F.arrays_zip("keys", "hashes", "times", "starts", "windows", "offsets")
    listed = signed.join(firsts, ["node", "row"]).select("node", "copies", F.explode(zipped).alias("s"))
    listed = listed.select(
        "node", F.col("s.keys").alias("key"), F.col("s.hashes").alias("hash"), (F.col("copies") * F.col("s.times")).alias("weight"), F.col("s.starts").alias("start"),
        F.col("s.windows").alias("windows"), F.col("s.offsets").alias("offset"),
    )
    shared = listed.groupBy("key").agg(F.sum("weight").alias("n")).filter("n > 1").select("key")
    listed = cut_lineage(listed.join(shared, "key"))
    first = F.min(F.struct("node", "start", "windows", "offset")).alias("first")
    segments = listed.groupBy("key", "hash").agg(F.sum("weight").alias("weight"), first)
    classes = segments.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("least")).filter("n > 1 AND least = 1")
    open_ = segments.join(classes, "key").select("first.*", "key", "hash", "weight", (F.col("n") > MOST_IN_CLASS).alias("large"))
    wanted = open_.groupBy("node").agg(F.collect_list(F.struct("key", "hash", "weight", "start", "windows", "offset", "large")).alias("wanted"))
    content = cut_lineage(rows.join(wanted, "node").select("text", "wanted").mapInArrow(_fetch(kind), _CONTENT))
    release_shuffles(rows.sparkSession)  # the texts' first exchange, before their second
    parts = content.filter("parent_key IS NOT NULL")
    part = parts.groupBy("key", "hash").agg(F.sum("weight").alias("weight"), F.first("content").alias("content"), F.first("offset").alias("offset"))
    met = part.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("least")).filter("n > 1 AND least = 1")
    met = part.join(met, "key")
    small = content.filter("parent_key IS NULL").select("key", "hash", "offset", "content").unionByName(met.filter(F.col("n") <= MOST_IN_CLASS).select("key", "hash", "offset", "content"))
    settled = small.repartition("key").sortWithinPartitions("key", "hash").mapInArrow(_settle(kind), "key bigint, hash bigint, repeated array<int>")
    settled = cut_lineage(settled)
    windows = met.filter(F.col("n") > MOST_IN_CLASS).select("key", "hash", "weight", "content").mapInArrow(_windows(kind), "key bigint, hash bigint, weight bigint, window_hash bigint, window int")
    many = windows.groupBy("window_hash").agg(F.sum("weight").alias("n")).filter("n > 1").select("window_hash")
    split = windows.join(many, "window_hash").groupBy("key", "hash").agg(F.collect_list("window").alias("repeated"))
    twice = part.filter("weight > 1").select("key", "hash", F.lit(None).cast("array<int>").alias("repeated"))
    of_parts = twice.unionByName(settled.unionByName(split).join(part.filter("weight = 1").select("key", "hash"), ["key", "hash"], "left_semi"))
    every = F.sequence(F.lit(0), F.col("windows") - 1)
    within = parts.join(of_parts, ["key", "hash"]).select(
        F.col("parent_key").alias("key"), F.col("parent_hash").alias("hash"), F.transform(F.coalesce("repeated", every), lambda w: w + F.col("base")).alias("repeated")
    ).groupBy("key", "hash").agg(F.flatten(F.collect_list("repeated")).alias("repeated"))
    counted = segments.filter("weight > 1").select("key", "hash", F.lit(None).cast("array<int>").alias("repeated"))
    single = segments.filter("weight = 1").select("key", "hash")
    verdicts = counted.unionByName(settled.unionByName(within).join(single, ["key", "hash"], "left_semi"))
    known = listed.select("node", "key", "hash").join(verdicts, ["key", "hash"]).groupBy("node").agg(F.collect_list(F.struct("hash", "repeated")).alias("known"))
    return known, firsts.filter("copies > 1").select("node", "copies")


def remove_repeats(docs: DataFrame, kind: Windows, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_units, n_removed, n_spans (maximal removed runs) and kept_sha256 for every row of `docs`.

    A unit goes if any window of `kind.width` units that covers it also starts anywhere else, in the same text or in another row. Null
    texts are empty; repeated rows are copies of each other; null ids stay null.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("node", node_of(F.col("text")))
    known, copied = repeated_segments(rows, kind)
    facts = known.join(copied, "node", "full_outer").select("node", F.col("copies").isNotNull().alias("copied"), "known")
    met = rows.join(facts, "node", "left").select("doc_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "known")
    return met.mapInArrow(_apply(kind), "doc_id bigint, n_units bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
