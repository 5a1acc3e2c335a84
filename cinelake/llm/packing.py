"""Best-fit packing planned on a histogram of lengths.

Best-fit decreasing needs only how many pieces have each length, so the plan is made from at most `capacity` counts and says, for
every length, which ranks go to which sequences at which offset. Pieces then take their places by joining on rank within length.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from struct import pack

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cinelake.llm.ranks import running_totals
from cinelake.llm.texts import kept_in_worker
from cinelake.session import cut_lineage

CAPACITY, END_ID = 4096, 1
KEPT_WORDS, KEPT_PARTS, KEPT_LENGTH = 250_000, 1_000_000, 64
PLAN_CELLS = 64
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
# the tokenizer's own split, for lower-case ASCII
_ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_ODD = re.compile("[\x1c-\x1f]")


class _Known(dict):
    """Values by key; missing ones are made, and kept unless the key is long."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= KEPT_LENGTH:
            self[key] = value
        return value


class _Encoder:
    """Token ids as little-endian bytes; parts of words met before, and words of texts beyond ASCII, are looked up. What is kept is bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.parts = _Known(self._ids)
        self.words = _Known(self._word)

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _ascii(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _ASCII_PARTS.findall(text.lower())))

    def _word(self, word: str) -> bytes:
        return self._ascii(word) if word.isascii() and "<|" not in word else self.parts[word]

    def encode(self, text: str) -> bytes:
        for known, most in ((self.words, KEPT_WORDS), (self.parts, KEPT_PARTS)):
            if len(known) > most:
                known.clear()
        if _ODD.search(text):  # separators that Python counts as white space and the tokenizer does not
            return self._ids(text)
        if text.isascii() and "<|" not in text:
            return self._ascii(text)
        # neither words nor parts reach over white space, so a text is the sum of its words
        return b"".join(map(self.words.__getitem__, text.split()))


def _pieces(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(path, lambda: _Encoder(path))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows = []
            for doc_id, text in zip(ids, texts):
                data = encoder.encode(text.as_py() or "") + pack("<I", end_id)
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, sequences, pieces in each, first sequence, offset).

    Ranks first .. first + sequences * pieces - 1 of that length fill `sequences` sequences from `first sequence` on, `pieces` in each.
    Sequences with equal room are kept as one range, so the work follows the number of lengths, not of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    plan, opened = [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                room[left] = []
                bisect.insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(at)
            else:
                left, first, n = capacity, opened, -(-todo // (capacity // length))
                opened += n
            each = left // length
            filled = min(n, todo // each)
            if filled == 0:
                each, filled = todo, 1
            plan.append((length, rank, filled, each, first, capacity - left))
            put(left - each * length, first, filled)
            put(left, first + filled, n - filled)
            rank += filled * each
            todo -= filled * each
    return plan


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document as pieces of at most `capacity` tokens, each with its sequence and its offset there.

    A document is its token ids followed by `end_id`; a null or empty text is `end_id` alone. Only documents longer than `capacity`
    are cut. Repeated rows and null ids are packed like any others; other columns are ignored; an empty table gives no rows.
    The tokenizer is read from `tokenizer_path` on every worker.
    """
    cut = docs.select(docs[doc_id].cast("bigint"), docs[text]).mapInArrow(_pieces(tokenizer_path, capacity, end_id), PIECES)
    pieces = cut_lineage(cut)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        best_fit_plan(counts, capacity), "length bigint, first_rank bigint, n_sequences bigint, each bigint, first_sequence bigint, first_offset bigint"
    )
    total = spark.createDataFrame(list(counts.items()), "length bigint, n bigint")
    cell = lambda rank, n: F.floor(rank * PLAN_CELLS / n)
    places = plan.join(F.broadcast(total), "length").select(  # bounded by the number of lengths, not of pieces
        "*", F.explode(F.sequence(cell(F.col("first_rank"), F.col("n")), cell(F.col("first_rank") + F.col("n_sequences") * F.col("each") - 1, F.col("n")))).alias("cell")
    )
    ranked = running_totals(pieces.withColumn("__one", F.lit(1).cast("bigint")), ["length"], ["doc_id", "piece", "ids_crc32"], "__one", "__rank")
    ranked = ranked.withColumn("cell", cell(F.col("__rank"), F.col("group_rows")))
    step = F.col("__rank") - F.col("first_rank")
    return (
        ranked.join(F.broadcast(places.drop("n")), ["length", "cell"])
        .filter((step >= 0) & (step < F.col("n_sequences") * F.col("each")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.floor(step / F.col("each"))).alias("sequence_id"),
            (F.col("first_offset") + step % F.col("each") * F.col("length")).alias("offset"),
        )
    )
