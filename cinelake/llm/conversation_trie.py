"""The trie of what conversations begin with, from sorted sequences and their longest common prefixes.

A turn is a digest of role and text. Distinct sequences are sorted; a prefix is a run of neighbours whose common prefixes are at least as
long, and its ends are found by binary search on a sparse table of range minima, left and right apart and without a stack. The sorted
sequences are dealt by range, so a partition knows from one summary row of every other one where a run that leaves it ends.

Sequences longer than `BLOCK` turns are sorted block by block, each block under a digest of all before it; sums over a subtree reach the
blocks above by pointer doubling. No task holds more than a partition of bounded size, whatever the length of a conversation or the number
of its copies.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cinelake.operators.skew import ROWS_PER_SALT, range_segments, row_number_across, running_sum_across, salted_lookup
from cinelake.session import cut_lineage

BLOCK = 512
#: Turns of distinct sequences in a partition.
TURNS_PER_TASK = 1_000_000
#: Members in one piece of a list that is hashed.
PIECE = 50_000
ROOT = "root"
_FAR = np.iinfo(np.int64).max


class Minima:
    """Range minima of an array by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            half = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - half], last[half:]))
        self.n = len(values)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Minima of [start, end); none may be empty."""
        level = np.maximum(np.int64(np.log2(np.maximum(ends - starts, 1))), 0)
        out = np.empty(len(starts), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][starts[at]], self.levels[k][ends[at] - (1 << int(k))])
        return out

    def right(self, starts: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place at or after `starts` whose value is below `least`; the length of the array if there is none."""
        at = starts.copy()
        for k in reversed(range(len(self.levels))):
            table, step = self.levels[k], 1 << k
            fits = np.flatnonzero(at + step <= self.n)
            fits = fits[table[at[fits]] >= least[fits]]
            at[fits] += step
        return at

    def left(self, ends: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place before `ends` whose value is below `least`; -1 if there is none."""
        at = ends.copy()
        for k in reversed(range(len(self.levels))):
            table, step = self.levels[k], 1 << k
            fits = np.flatnonzero(at >= step)
            fits = fits[table[at[fits] - step] >= least[fits]]
            at[fits] -= step
        return at - 1


# -- sequences ---------------------------------------------------------------------------------------------------------------------


def turn_digests(conversations: DataFrame, rows_per_segment: int = ROWS_PER_SALT) -> DataFrame:
    """(conv_id, place, symbol, chars): turns numbered from 1 by turn (null first), role, digest; a null role or text is empty.

    Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("symbol"), F.length(text).cast("bigint").alias("chars"),
    )
    order = ["turn", "role", "symbol"]
    placed = row_number_across(range_segments(rows, ["conv_id"], order, "__segment", rows_per_segment), ["conv_id"], "__segment", order, "place")
    return placed.select("conv_id", "place", "symbol", "chars")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6, rows_per_segment: int = ROWS_PER_SALT) -> tuple[DataFrame, DataFrame]:
    """Turns and members (conv_id) of conversations that begin like the first of their group.

    With h = crc32(conv_id) % most, a conversation takes the first h turns of the one whose id is its own rounded down to a multiple of
    `group` (none if that is absent), then its own turns after the first h.
    """
    turns = cut_lineage(turns)
    head = F.array_sort(F.collect_list(F.struct("place", "symbol", "chars")))
    heads = turns.filter((F.pmod("conv_id", F.lit(group)) == 0) & (F.col("place") < most)).groupBy("conv_id").agg(head.alias("head")).withColumnRenamed("conv_id", "first_id")
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", taken).withColumn("first_id", F.col("conv_id") - F.pmod("conv_id", F.lit(group)))
    convs = convs.join(heads, "first_id", "left").withColumn("head", F.when(F.col("head").isNotNull() & (F.col("h") > 0), F.slice("head", 1, F.greatest("h", F.lit(1)))))
    kept = F.when(F.col("head").isNull(), 0).otherwise(F.size("head"))
    convs = cut_lineage(convs.select("conv_id", "n", "head", (F.col("h") - kept).cast("bigint").alias("shift")))
    given = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.place", "t.symbol", "t.chars")
    own = salted_lookup(turns.filter(F.col("place") > taken), convs.select("conv_id", "n", "shift"), ["conv_id"], "n", "inner", rows_per_segment)
    own = own.select("conv_id", (F.col("place") - F.col("shift")).alias("place"), "symbol", "chars")
    return given.unionByName(own), convs.select("conv_id")


def _records(turns: DataFrame, block: int, rows_per_segment: int) -> DataFrame:
    """(conv_id, block, prefix, symbols, lengths, is_last, next): one row per conversation and block of turns."""
    item = F.array_sort(F.collect_list(F.struct("place", "symbol", "chars")))
    rows = turns.groupBy("conv_id", F.floor((F.col("place") - 1) / block).cast("bigint").alias("block")).agg(item.alias("items"))
    rows = rows.select(
        "conv_id", "block", F.unhex(F.array_join(F.transform("items", lambda x: x["symbol"]), "")).alias("symbols"), F.transform("items", lambda x: x["chars"]).alias("lengths"),
    )
    last = turns.groupBy("conv_id").agg(F.max("place").alias("total"))
    rows = cut_lineage(salted_lookup(rows, last, ["conv_id"], "total", "inner", rows_per_segment))
    short = rows.filter(F.col("total") <= block).select(
        "conv_id", "block", F.lit("").alias("prefix"), "symbols", "lengths", F.lit(True).alias("is_last"), F.lit(None).cast("string").alias("next")
    )
    values = [F.xxhash64(F.lit(salt), "block", "symbols").cast("decimal(20,0)") for salt in (1, 2)]
    long = rows.filter(F.col("total") > block).withColumn("__segment", F.floor(F.col("block") / 4096)).withColumn("v1", values[0]).withColumn("v2", values[1])
    for i in (1, 2):
        long = running_sum_across(long, ["conv_id"], "__segment", ["block"], F.col(f"v{i}"), f"s{i}", exclusive=True)
    so_far = F.when(F.col("block") == 0, "").otherwise(F.concat_ws(",", F.col("s1").cast("decimal(38,0)").cast("string"), F.col("s2").cast("decimal(38,0)").cast("string")))
    after = F.concat_ws(",", *[(F.col(f"s{i}") + F.col(f"v{i}")).cast("decimal(38,0)").cast("string") for i in (1, 2)])
    is_last = F.col("total") <= (F.col("block") + 1) * block
    return short.unionByName(long.select("conv_id", "block", so_far.alias("prefix"), "symbols", "lengths", is_last.alias("is_last"), F.when(~is_last, after).alias("next")))


def _node_key():
    return F.md5(F.concat(F.concat_ws("/", F.col("block").cast("string"), "prefix", F.lit("")).cast("binary"), F.col("symbols")))


# -- partitions of sorted sequences ------------------------------------------------------------------------------------------------

_RECORD = ("part", "block", "prefix", "symbols", "lengths", "conv", "n", "n_ends", "continued", "node_key", "above_conv", "more_saved", "more_leaves", "more_children")


class Partition:
    """The sorted records of a partition as arrays."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.part = table.column("part")[0].as_py()
        self.n_records = len(table)
        self.block = np.asarray(table.column("block"))
        symbols = table.column("symbols").cast(pa.large_binary()).combine_chunks()
        symbols = symbols.chunk(0) if isinstance(symbols, pa.ChunkedArray) else symbols
        bounds = np.frombuffer(symbols.buffers()[1], np.int64)[symbols.offset : symbols.offset + len(symbols) + 1]
        data = np.frombuffer(symbols.buffers()[2], np.uint64, (bounds[-1] - bounds[0]) // 8, bounds[0]).reshape(-1, 2)
        self.symbols, self.bounds = data, (bounds - bounds[0]) // 16
        self.length = np.diff(self.bounds)
        self.prefix = table.column("prefix").combine_chunks()
        self.prefix = self.prefix.chunk(0) if isinstance(self.prefix, pa.ChunkedArray) else self.prefix
        _, self.prefix_id = np.unique(np.asarray(self.prefix.dictionary_encode().indices), return_inverse=True)
        self.table = table
        self.conv, self.n = self.longs("conv"), self.longs("n")
        self.lcp = self._common()

    def longs(self, name: str) -> np.ndarray:
        return np.asarray(self.table.column(name).fill_null(0)).astype(np.int64)

    def _common(self) -> np.ndarray:
        """Turns that each record has in common with the one before it in its group; 0 for the first."""
        n = self.n_records
        lcp = np.zeros(n, np.int64)
        if n < 2:
            return lcp
        same = (self.block[1:] == self.block[:-1]) & (self.prefix_id[1:] == self.prefix_id[:-1])
        most = np.where(same, np.minimum(self.length[1:], self.length[:-1]), 0)
        record = np.repeat(np.arange(n - 1), most)
        step = np.arange(len(record)) - np.repeat(np.cumsum(most) - most, most)
        a, b = self.bounds[:-2][record] + step, self.bounds[1:-1][record] + step
        differ = (self.symbols[a] != self.symbols[b]).any(1)
        np.minimum.at(most, record[differ], step[differ])
        lcp[1:] = most
        return lcp

    def edge(self, at: int) -> tuple:
        return int(self.block[at]), self.prefix[at].as_py(), self.symbols[self.bounds[at] : self.bounds[at + 1]].tobytes()


def _partition(batches: Iterator[pa.RecordBatch]) -> Partition | None:
    held = [b for b in batches if b.num_rows]
    return Partition(pa.Table.from_batches(held)) if held else None


_SUMMARY = (
    "part bigint, n bigint, conv bigint, least bigint, first_block bigint, first_prefix string, first_symbols binary, last_block bigint, last_prefix string, last_symbols binary, "
    "right_at array<bigint>, right_lcp array<bigint>, right_n array<bigint>, right_conv array<bigint>, left_at array<bigint>, left_lcp array<bigint>, left_conv array<bigint>"
)


def _falls(values: np.ndarray) -> np.ndarray:
    """Places where the running minimum falls."""
    low = np.minimum.accumulate(values)
    return np.flatnonzero(np.concatenate([[True], low[1:] < low[:-1]])) if len(values) else np.zeros(0, np.int64)


def _summarized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per partition: its ends, and where a run of each depth that enters it from either side stops."""
    p = _partition(batches)
    if p is None:
        return
    inner = p.lcp[1:]
    right = _falls(inner) + 1
    left = p.n_records - 1 - _falls(inner[::-1])
    sums, low = np.concatenate([[0], np.cumsum(p.n)]), np.minimum.accumulate(p.conv)
    back = np.minimum.accumulate(p.conv[::-1])[::-1]
    row = {
        "part": p.part, "n": int(sums[-1]), "conv": int(low[-1]), "least": int(inner.min()) if len(inner) else _FAR,
        **dict(zip(("first_block", "first_prefix", "first_symbols"), p.edge(0))), **dict(zip(("last_block", "last_prefix", "last_symbols"), p.edge(p.n_records - 1))),
        "right_at": right.tolist(), "right_lcp": p.lcp[right].tolist(), "right_n": sums[right].tolist(), "right_conv": low[right - 1].tolist(),
        "left_at": left.tolist(), "left_lcp": p.lcp[left].tolist(), "left_conv": back[left].tolist(),
    }
    yield pa.RecordBatch.from_pylist([row], schema=_SUMMARY_SCHEMA)


_LONGS = pa.list_(pa.int64())
_SUMMARY_SCHEMA = pa.schema(
    [(n, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": _LONGS}[t]) for n, t in (x.split() for x in _SUMMARY.split(", "))]
)


class Neighbours:
    """Where runs that leave a partition end, from the summaries of all partitions in order."""

    def __init__(self, summaries: list[dict]):
        self.rows = sorted(summaries, key=lambda r: r["part"])
        self.place = {r["part"]: i for i, r in enumerate(self.rows)}
        self.edge = np.zeros(len(self.rows), np.int64)
        for i in range(1, len(self.rows)):
            a, b = self.rows[i - 1], self.rows[i]
            if (a["last_block"], a["last_prefix"]) == (b["first_block"], b["first_prefix"]):
                x, y = a["last_symbols"], b["first_symbols"]
                n = min(len(x), len(y)) // 16
                differ = np.flatnonzero((np.frombuffer(x, np.uint64, 2 * n) != np.frombuffer(y, np.uint64, 2 * n)).reshape(-1, 2).any(1))
                self.edge[i] = differ[0] if len(differ) else n
        least = np.minimum(self.edge, np.array([r["least"] for r in self.rows], np.int64))
        self.least = Minima(least)
        self.sums = np.concatenate([[0], np.cumsum([r["n"] for r in self.rows])]).astype(np.int64)
        self.convs = Minima(np.array([r["conv"] for r in self.rows], np.int64))
        for r in self.rows:
            del r["first_symbols"], r["last_symbols"]

    def before(self, part: int) -> int:
        """Turns in common across the start of a partition."""
        return int(self.edge[self.place[part]])

    def after(self, part: int) -> int:
        i = self.place[part] + 1
        return int(self.edge[i]) if i < len(self.rows) else 0

    def _between(self, first: int, last: int) -> int:
        return int(self.convs.of(np.array([first]), np.array([last]))[0]) if first < last else _FAR

    def right(self, part: int, depth: int) -> tuple[int, int]:
        """(members, least member) of the rest of a run of `depth` that leaves the partition at its end."""
        i = self.place[part] + 1
        q = int(self.least.right(np.array([i]), np.array([depth]))[0])
        n, conv = int(self.sums[q] - self.sums[i]), self._between(i, q)
        if q < len(self.rows) and self.edge[q] >= depth:
            r = self.rows[q]
            at = next(j for j, x in enumerate(r["right_lcp"]) if x < depth)
            n, conv = n + r["right_n"][at], min(conv, r["right_conv"][at])
        return n, conv

    def left(self, part: int, depth: int) -> tuple[int, int, int]:
        """(partition, place, least member) where a run of `depth` that leaves the partition at its start begins."""
        i = self.place[part]
        q = int(self.least.left(np.array([i]), np.array([depth]))[0])
        r = self.rows[q]
        at = next((j for j, x in enumerate(r["left_lcp"]) if x < depth), None)
        whole = self._between(q + 1, i)
        if at is None:
            return r["part"], 0, min(whole, r["conv"])
        return r["part"], r["left_at"][at], min(whole, r["left_conv"][at])


_NODE = (
    "carried boolean, part bigint, place bigint, level bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, own_saved bigint, own_leaf bigint, node_key string"
)


def _resolved(near: Neighbours, root_conv: int, block: int, groups: bool):
    """Task: the nodes that a partition's records are first in, and what it adds to nodes that begin in earlier partitions.

    With `groups`, sums of each group of records under the same prefix instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _partition(batches)
        if p is None:
            return
        n, lcp = p.n_records, p.lcp
        lcp[0] = near.before(p.part)
        minima, convs = Minima(lcp), Minima(p.conv)
        members = np.concatenate([[0], np.cumsum(p.n)])
        # a candidate is a record and a depth at which no record before has the same turns
        new = p.length - lcp
        starts = np.concatenate([[0], np.cumsum(new)])
        record = np.repeat(np.arange(n), new)
        level = np.arange(len(record)) - starts[record] + lcp[record] + 1
        right = minima.right(record + 1, level)
        n_convs = members[right] - members[record]
        conv = convs.of(record, right)
        leaving = right == n
        for depth in np.unique(level[leaving & (level <= near.after(p.part))]):
            more, other = near.right(p.part, int(depth))
            at = leaving & (level == depth)
            n_convs[at] += more
            conv[at] = np.minimum(conv[at], other)
        flat = np.asarray(p.table.column("lengths").combine_chunks().flatten()).astype(np.int64)
        chars = flat[p.bounds[record] + level - 1]
        own_saved = (n_convs - 1) * chars
        last = level == p.length[record]
        follows = np.append(lcp[1:], near.after(p.part))
        continued = np.asarray(p.table.column("continued")).astype(bool)
        own_leaf = (last & (follows[record] < level) & ~continued[record]).astype(np.int64)
        more = [np.concatenate([[0], np.cumsum(p.longs(c))]) for c in ("more_saved", "more_leaves")]
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (own_saved, own_leaf)]
        if groups:
            change = np.flatnonzero(np.concatenate([[True], (p.block[1:] != p.block[:-1]) | (p.prefix_id[1:] != p.prefix_id[:-1])]))
            ends = np.append(change[1:], n)
            roots = np.concatenate([[0], np.cumsum(lcp == 0)])
            yield pa.RecordBatch.from_pydict(
                {"block": p.block[change], "prefix": p.prefix.take(pa.array(change)), "saved": sums[0][starts[ends]] - sums[0][starts[change]],
                 "leaves": sums[1][starts[ends]] - sums[1][starts[change]], "roots": roots[ends] - roots[change]}
            )
            return
        node = np.arange(len(record))
        saved = sums[0][starts[right]] - sums[0][node] + more[0][right] - more[0][record]
        leaves = sums[1][starts[right]] - sums[1][node] + more[1][right] - more[1][record]
        # the parent of a record's first new node is the run of depth lcp around the record
        branch = np.flatnonzero(lcp > 0)
        depth = lcp[branch]
        begin, end = minima.left(branch + 1, depth), minima.right(branch + 1, depth)
        parent = convs.of(np.maximum(begin, 0), end)
        for d in np.unique(depth[end == n]):
            if d <= near.after(p.part):
                at = (end == n) & (depth == d)
                parent[at] = np.minimum(parent[at], near.right(p.part, int(d))[1])
        carried = []
        outside = begin < 0
        kids = np.bincount(depth[outside], minlength=lcp[0] + 1) if outside.any() else np.zeros(lcp[0] + 1, np.int64)
        for d in range(1, int(lcp[0]) + 1):
            part, place, other = near.left(p.part, d)
            at = outside & (depth == d)
            parent[at] = np.minimum(parent[at], other)
            stop = int(minima.right(np.array([1]), np.array([d]))[0])
            carried.append((part, place, d, int(kids[d]), int(sums[1][starts[stop]] + more[1][stop]), int(sums[0][starts[stop]] + more[0][stop])))
        parents = np.empty(len(record), np.int64)
        first = starts[:-1]
        parents[1:] = conv[:-1]
        parents[first] = np.where(p.block == 0, root_conv, p.longs("above_conv"))
        parents[first[branch]] = parent
        children = (~last).astype(np.int64)
        inside = ~outside
        np.add.at(children, first[begin[inside]] + depth[inside] - lcp[begin[inside]] - 1, 1)
        children[starts[1:] - 1] += p.longs("more_children")
        keys = p.table.column("node_key").combine_chunks().take(pa.array(record))
        keyed = last & (p.longs("n_ends")[record] > 0)
        keys = pc.if_else(pa.array(keyed), keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys, pa.scalar(None, pa.string()))
        yield pa.RecordBatch.from_pydict(
            {
                "carried": np.zeros(len(record), bool), "part": np.full(len(record), p.part), "place": record, "level": level, "depth": p.block[record] * block + level, "conv_id": conv,
                "parent_conv_id": parents, "n_convs": n_convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "own_saved": own_saved, "own_leaf": own_leaf, "node_key": keys,
            }
        )
        if carried:
            part, place, d, kids, leaf, save = zip(*carried)
            none = pa.nulls(len(carried), pa.int64())
            yield pa.RecordBatch.from_pydict(
                {
                    "carried": [True] * len(carried), "part": pa.array(part, pa.int64()), "place": pa.array(place, pa.int64()), "level": pa.array(d, pa.int64()), "depth": none, "conv_id": none,
                    "parent_conv_id": none, "n_convs": none, "n_children": pa.array(kids, pa.int64()), "n_leaves": pa.array(leaf, pa.int64()), "saved_tokens": pa.array(save, pa.int64()),
                    "own_saved": none, "own_leaf": none, "node_key": pa.nulls(len(carried), pa.string()),
                }
            )

    return run


def _below(sorted_records: DataFrame, near: Neighbours, block: int, most: int) -> DataFrame:
    """(prefix, more_saved, more_leaves, more_children) of everything under each group of a block after the first."""
    sums = sorted_records.mapInArrow(_resolved(near, 0, block, True), "block bigint, prefix string, saved bigint, leaves bigint, roots bigint")
    sums = sums.filter("block > 0").groupBy("block", "prefix").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.sum("roots").alias("roots"))
    above = sorted_records.filter("continued").select(F.col("next").alias("prefix"), F.when(F.col("block") > 0, F.col("prefix")).alias("jump"))
    groups = cut_lineage(sums.join(above, "prefix").select("prefix", "jump", "saved", "leaves", "roots"))
    for _ in range(math.ceil(math.log2(most + 1))):
        given = groups.filter("jump is not null").groupBy(F.col("jump").alias("prefix")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        farther = groups.select(F.col("prefix").alias("jump"), F.col("jump").alias("far"))
        groups = cut_lineage(
            groups.join(given, "prefix", "left").join(farther, "jump", "left").select(
                "prefix", F.col("far").alias("jump"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), "roots",
            )
        )
    return groups.select(F.col("prefix").alias("next"), F.col("saved").alias("s"), F.col("leaves").alias("l"), F.col("roots").alias("r"))


# -- members that end at a node ----------------------------------------------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node_key, conv_id, part) in, comma-joined ids in pieces out."""
    key, part, ids, piece = None, None, [], 0

    def row():
        return {"node_key": key, "part": part, "piece": piece, "ids": ",".join(map(str, ids))}

    for batch in batches:
        out = []
        part = batch.column("part")[0].as_py() if batch.num_rows else part
        for k, conv in zip(batch.column("node_key").to_pylist(), batch.column("conv_id").to_pylist()):
            if k != key or len(ids) >= PIECE:
                if ids:
                    out.append(row())
                    piece += 1
                key, ids = k, []
            ids.append(conv)
        yield pa.RecordBatch.from_pylist(out, schema=_PIECES)
    if ids:
        yield pa.RecordBatch.from_pylist([row()], schema=_PIECES)


_PIECES = pa.schema([("node_key", pa.string()), ("part", pa.int64()), ("piece", pa.int64()), ("ids", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None
    schema = pa.schema([("node_key", pa.string()), ("ends_sha256", pa.string())])
    for batch in batches:
        done = []
        for k, ids in zip(batch.column("node_key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key:
                if digest is not None:
                    done.append({"node_key": key, "ends_sha256": digest.hexdigest()})
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"node_key": key, "ends_sha256": digest.hexdigest()}], schema=schema)


def _digests(ends: DataFrame) -> DataFrame:
    """(node_key, ends_sha256); the ids of a node that many conversations end at are joined in many tasks, hashing alone is one stream."""
    ranged = ends.repartitionByRange("node_key", "conv_id").sortWithinPartitions("node_key", "conv_id").withColumn("part", F.spark_partition_id().cast("bigint"))
    pieces = ranged.mapInArrow(_pieces, "node_key string, part bigint, piece bigint, ids string")
    return pieces.repartition("node_key").sortWithinPartitions("node_key", "part", "piece").mapInArrow(_hashed, "node_key string, ends_sha256 string")


# -- the trie ----------------------------------------------------------------------------------------------------------------------


def prefix_trie(turns: DataFrame, members: DataFrame, block: int = BLOCK, turns_per_task: int = TURNS_PER_TASK, rows_per_segment: int = ROWS_PER_SALT) -> DataFrame:
    """One row per distinct beginning of the conversations `members` (conv_id, distinct), whose turns are `turns` (conv_id, place, symbol, chars).

    place counts from 1 without gaps; symbol is a hexadecimal 128-bit digest. Columns: conv_id (smallest member), depth, parent_conv_id (null
    at the root), n_convs, n_children, n_leaves, saved_tokens (over the subtree, what is not stored again if equal beginnings are kept once),
    ends_sha256 (of the members that end at the node, ascending). A member without turns ends at the root; without members there are no rows.
    """
    spark = turns.sparkSession
    turns = cut_lineage(turns.select("conv_id", F.col("place").cast("bigint").alias("place"), "symbol", F.col("chars").cast("bigint").alias("chars")))
    totals = members.agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n")).first()
    n_turns = turns.count()
    records = cut_lineage(_records(turns, block, rows_per_segment).withColumn("node_key", _node_key()))
    distinct = records.groupBy("block", "prefix", "symbols", "node_key").agg(
        F.min("lengths").alias("lengths"), F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"), F.count_if("is_last").alias("n_ends"), F.max("next").alias("next"),
    ).withColumn("continued", F.col("next").isNotNull())
    most = records.agg(F.max("block")).first()[0] or 0
    zero = F.lit(0).cast("bigint")
    distinct = distinct.withColumn("above_conv", F.lit(None).cast("bigint"))
    if most > 0:
        distinct = cut_lineage(distinct)
        above = distinct.filter("continued").select(F.col("next").alias("prefix"), F.col("conv").alias("above"))
        first, later = distinct.filter("block = 0"), distinct.filter("block > 0").join(above, "prefix").withColumn("above_conv", F.col("above")).drop("above")
        distinct = first.unionByName(later)
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_turns / turns_per_task))
    order = ["block", "prefix", "symbols"]
    ranged = distinct.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("bigint"))
    ranged = cut_lineage(ranged.withColumns({"more_saved": zero, "more_leaves": zero, "more_children": zero}))
    # one row per partition: its two edge records and at most two numbers per turn of a block
    near = Neighbours([r.asDict() for r in ranged.select(*_RECORD).mapInArrow(_summarized, _SUMMARY).collect()])
    if most > 0:
        below = _below(ranged, near, block, most)
        whole = [F.coalesce(F.col(x), zero).alias(name) for x, name in (("s", "more_saved"), ("l", "more_leaves"), ("r", "more_children"))]
        rest = [c for c in _RECORD if not c.startswith("more_")]
        # the same rows per partition, in the same order
        joined = ranged.filter("continued").join(below, "next", "left").select(*rest, *whole)
        again = joined.unionByName(ranged.filter("not continued").select(*_RECORD))
        ranged = again.repartition(n_parts, "part").sortWithinPartitions("part", *order)
        nodes = ranged.mapInArrow(_by_part(near, totals["conv"] or 0, block), _NODE)
    else:
        nodes = ranged.select(*_RECORD).mapInArrow(_resolved(near, totals["conv"] or 0, block, False), _NODE)
    nodes = cut_lineage(nodes)
    ends = records.filter("is_last").select("node_key", "conv_id")
    idle = members.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").select(F.lit(ROOT).alias("node_key"), "conv_id")
    digests = cut_lineage(_digests(ends.unionByName(idle)))

    place = ["part", "place", "level"]
    sums = ("n_children", "n_leaves", "saved_tokens")
    carried = nodes.filter("carried").groupBy(*place).agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
    own = nodes.filter("not carried").join(carried, place, "left")
    own = own.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", *[(F.col(c) + F.coalesce(f"more_{c}", zero)).alias(c) for c in sums], "node_key",
    )
    empty = F.sha2(F.lit("").cast("binary"), 256)
    ended = own.filter("node_key is not null").join(digests, "node_key", "left").drop("node_key")
    open_ = own.filter("node_key is null").drop("node_key").withColumn("ends_sha256", empty)
    top = nodes.filter("not carried").agg(
        F.count_if(F.col("depth") == 1).alias("n_children"), F.coalesce(F.sum("own_leaf"), zero).alias("n_leaves"), F.coalesce(F.sum("own_saved"), zero).alias("saved_tokens")
    )
    none = F.lit(None).cast("bigint")
    root = top.select(
        F.lit(totals["conv"]).cast("bigint").alias("conv_id"), zero.alias("depth"), none.alias("parent_conv_id"), F.lit(totals["n"]).cast("bigint").alias("n_convs"), "n_children",
        F.greatest("n_leaves", F.lit(1).cast("bigint")).alias("n_leaves"), "saved_tokens", F.lit(ROOT).alias("node_key"),
    ).filter("n_convs > 0").join(digests, "node_key", "left").drop("node_key").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    return root.unionByName(ended).unionByName(open_)


def _by_part(near: Neighbours, root_conv: int, block: int):
    """As `_resolved`, for tasks that hold several partitions one after the other."""
    resolve = _resolved(near, root_conv, block, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            parts = np.asarray(batch.column("part"))
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and held[0].column("part")[0].as_py() != parts[a]:
                    yield from resolve(iter(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from resolve(iter(held))

    return run
