"""Exact top-k inner products by segment statistics, coarse to fine.

For vectors cut into segments, the inner product of two segments of length L is at most L * (mean * mean + deviation * deviation).
Summed, that bounds the score from above (and the distance from below) at the cost of two numbers a segment. Candidates that the
coarse bound cannot dismiss meet the fine one; exact scores are computed for the survivors only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

RESOLUTIONS = (4, 16)
QUERIES_PER_CELL, ROWS_PER_CELL, BLOCK = 2048, 262_144, 1024
_LONG = 2**63 - 1
SCHEMA = "query_id bigint, vec_id bigint, score bigint"


def _statistics(x: np.ndarray, n_segments: int) -> np.ndarray:
    """Per segment the mean and the deviation, each times the root of the length, so that a dot product is the bound."""
    n_segments = max(1, min(n_segments, x.shape[1]))
    edges = np.linspace(0, x.shape[1], n_segments + 1).astype(int)
    lengths = np.diff(edges)
    sums, squares = np.add.reduceat(x, edges[:-1], axis=1), np.add.reduceat(x * x, edges[:-1], axis=1)
    means = sums / lengths
    deviations = np.sqrt(np.maximum(squares / lengths - means * means, 0))
    return np.hstack([means, deviations]) * np.sqrt(np.tile(lengths, 2))


class _Queries:
    """The queries of one cell that have the same dimension, with their statistics and best scores so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.levels = [_statistics(vectors, n) for n in RESOLUTIONS] if vectors.shape[1] else []
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.most = float(np.abs(vectors).max(initial=0))
        self.best = np.full(len(ids), -np.inf)
        self.kept = [([], []) for _ in ids]

    def _exact(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        largest = self.most * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
        if largest < 2**53:
            return (self.vectors[q] @ x.T).astype(np.int64)
        whole = [[int(v) for v in row] for row in x]
        ours = [[int(v) for v in row] for row in self.vectors[q]]
        return np.array([[max(-_LONG, min(_LONG, sum(a * b for a, b in zip(u, v)))) for v in whole] for u in ours], dtype=np.int64).reshape(len(q), len(x))

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        alive = self.ids[:, None] != ids[None, :]
        norms = np.sqrt((x * x).sum(axis=1))
        slack = 1e-9 * self.norms[:, None] * norms[None, :] + 1e-6
        for ours, n in zip(self.levels, RESOLUTIONS):
            if not np.isfinite(self.best).any():
                continue
            q, r = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            if not len(q) or not len(r):
                return
            part = np.ix_(q, r)
            alive[part] &= ours[q] @ _statistics(x[r], n).T + slack[part] >= self.best[q, None]
        q, r = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(q) or not len(r):
            return
        scores, open_ = self._exact(q, x[r]), alive[np.ix_(q, r)]
        open_ &= scores >= self.best[q, None]
        for i in np.flatnonzero(open_.any(axis=1)):
            at, (known, names) = np.flatnonzero(open_[i]), self.kept[q[i]]
            s, n = np.concatenate([np.asarray(known, np.int64), scores[i, at]]), np.concatenate([np.asarray(names, np.int64), ids[r[at]]])
            order = np.lexsort((n, -s))[: self.k]
            self.kept[q[i]] = (s[order], n[order])
            if len(order) == self.k:
                self.best[q[i]] = s[order[-1]]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for query, (scores, names) in zip(self.ids.tolist(), self.kept):
            for s, n in zip(scores, names):
                yield query, int(n), int(s)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(cell, kind, ids, vectors) for runs of rows with the same cell, kind and dimension."""
    cells, kinds, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    vectors = batch.column(3)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0) | (np.diff(sizes) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
        if b > a:
            yield int(cells[a]), int(kinds[a]), ids[a:b].astype(np.int64), flat[ends[a] - sizes[a] : ends[b - 1]].reshape(b - a, sizes[a])


def _search(k: int, scale: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, ready = None, {}, {}

        def close():
            found = [row for queries in ready.values() for row in queries.rows()]
            if found:
                yield pa.RecordBatch.from_pydict(dict(zip(("query_id", "vec_id", "score"), (pa.array(c, pa.int64()) for c in zip(*found)))))

        for batch in batches:
            for at, kind, ids, vectors in _matrices(batch):
                if at != cell:
                    yield from close()
                    cell, waiting, ready = at, {}, {}
                vectors = np.floor(scale * vectors)
                if kind == 0:
                    waiting.setdefault(vectors.shape[1], []).append((ids, vectors))
                    continue
                for size, parts in waiting.items():
                    ready[size] = _Queries(np.concatenate([p[0] for p in parts]), np.vstack([p[1] for p in parts]), k)
                waiting = {}
                if vectors.shape[1] in ready:
                    for i in range(0, len(ids), BLOCK):
                        ready[vectors.shape[1]].meet(ids[i : i + BLOCK], vectors[i : i + BLOCK])
        yield from close()

    return search


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For every query the `k` rows of `vectors` with the highest inner product of floor(scale * component); ties to the smaller id.

    Returns query_id, rank (from 1), vec_id, score. A query never meets rows with its own id; a repeated query id counts once (with
    its smallest vector), repeated rows take a rank each. Ids and vectors that are null, and vectors with a null or non-finite
    component, take no part; vectors meet only those of the same dimension (empty ones score 0). Scores beyond a long stop at it.

    Queries and rows are dealt to cells of at most about `QUERIES_PER_CELL` x `ROWS_PER_CELL`; a cell streams its rows past its
    queries and hands on `k` rows per query.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = lambda df: df.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite)
    )
    rows, asked = usable(vectors), usable(queries).groupBy("id").agg(F.min("v").alias("v"))
    spark = vectors.sparkSession
    n_rows, n_asked = rows.count(), asked.count()
    row_cells = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_rows / ROWS_PER_CELL))
    query_cells = max(1, math.ceil(n_asked / QUERIES_PER_CELL))
    share = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    copies = lambda n, cell: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell)).alias("cell")
    dealt = asked.select(copies(row_cells, lambda r: r * query_cells + share(query_cells)), F.lit(0).alias("kind"), "id", "v").unionByName(
        rows.select(copies(query_cells, lambda q: share(row_cells) * query_cells + q), F.lit(1).alias("kind"), "id", "v")
    )
    best = dealt.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(_search(k, scale), SCHEMA)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
