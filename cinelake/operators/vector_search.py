"""Top-k search by inner product over unit vectors: exact, and by inverted lists."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from cinelake.functions.vectors import normalise
from cinelake.operators.topk import top_k

QUERY_BATCH, ROW_BATCH = 512, 4096
MAX_BROADCAST_QUERIES = 4096
ROW_BLOCK = 16_384
#: Blocks of larger tables hold up to this many times more, so that rows and queries are copied to fewer meetings.
MOST_GROWTH, BLOCKS = 4, 16


class Best:
    """The k best rows of every query over all blocks seen; ties go to the smaller row id.

    The k-th best score so far is a query's bound: a block's scores below it are never sorted or kept, and most blocks have no other.
    Products of matrices only choose; what they choose is summed component by component, so that equal vectors have equal scores
    wherever they lie.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.bound = np.full(len(queries), -np.inf)
        self.held = {}

    def add(self, ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Show a block to the queries at the places `asked`, by default to all."""
        if not len(ids):
            return
        asked = np.arange(len(self.queries)) if asked is None else asked
        ids, vectors = self._first_copies(ids, vectors)
        slack = 4 * vectors.shape[1] * np.finfo(np.float64).eps * _longest(vectors) * _longest(self.queries)
        for part in np.split(asked, np.flatnonzero(np.diff(asked // QUERY_BATCH)) + 1):
            for start in range(0, len(ids) if len(part) else 0, ROW_BATCH):
                self._meet(part, ids[start : start + ROW_BATCH], vectors[start : start + ROW_BATCH], slack)

    def _first_copies(self, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of equal vectors the k rows with the smallest ids: no query takes another."""
        _, group = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.itemsize * vectors.shape[1]}").ravel(), return_inverse=True)
        if group.max() + 1 == len(ids):
            return ids, vectors
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], group))
        group = group[order]
        kept = np.sort(order[np.arange(len(group)) - np.searchsorted(group, group) < self.k])
        return ids[kept], vectors[kept]

    def _meet(self, part: np.ndarray, ids: np.ndarray, vectors: np.ndarray, slack: float) -> None:
        queries, edge = self.queries[part], self.bound[part] - slack
        scores = vectors @ queries.T
        if len(ids) > self.k and np.isneginf(edge).any():
            edge = np.maximum(edge, -np.partition(-scores, self.k - 1, axis=0)[self.k - 1] - 2 * slack)
        row, query = np.nonzero(scores >= edge)
        if not len(row):
            return
        exact = np.zeros(len(row))
        for x, y in zip(vectors.T, queries.T):
            exact += x[row] * y[query]
        query, ids = part[query], ids[row]
        before = self.held.get(batch := int(part[0]) // QUERY_BATCH)
        if before is not None:
            query, ids, exact = (np.concatenate(x) for x in zip(before, (query, ids, exact)))
        _, place = np.unique(ids, return_inverse=True)
        order = np.lexsort((place, -exact, query))
        query, ids, exact = query[order], ids[order], exact[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        self.bound[query[rank == self.k - 1]] = exact[rank == self.k - 1]
        self.held[batch] = query[kept], ids[kept], exact[kept]

    def _all(self, i: int) -> np.ndarray | None:
        return np.concatenate([self.held[b][i] for b in sorted(self.held)]) if self.held else None

    @property
    def query(self) -> np.ndarray:
        return np.zeros(0, np.int64) if not self.held else self._all(0)

    @property
    def ids(self) -> np.ndarray | None:
        return self._all(1)

    @property
    def scores(self) -> np.ndarray:
        return np.zeros(0) if not self.held else self._all(2)


def _longest(vectors: np.ndarray) -> float:
    lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return lengths[np.isfinite(lengths)].max(initial=0.0)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def exact_top_k(
    vectors: DataFrame, ident: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int,
    max_broadcast: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """(query, row, score, rank) of the k rows with the largest inner product, for every query.

    Queries are normalised. Up to `max_broadcast` of them, by count, travel to every task; more are cut into
    blocks that meet blocks of rows. A task hands on at most k rows per query.
    """
    q = queries.select(F.col(query_id), normalise(F.col(query_vector)).alias("__q"))
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(ident), F.col(vector).alias("__v"))
    schema = f"{query_id} {dict(queries.dtypes)[query_id]}, {ident} {dict(vectors.dtypes)[ident]}, score double"
    n_queries = q.count()

    def frame(qs, ids, scores) -> pd.DataFrame:
        return pd.DataFrame({query_id: qs, ident: ids, "score": scores})

    if n_queries <= max_broadcast:
        local = q.toPandas()
        shared = vectors.sparkSession.sparkContext.broadcast(
            (local[query_id].to_numpy(), _stack(local["__q"]) if n_queries else np.zeros((0, 1)))
        )

        def scan(batches):
            qs, matrix = shared.value
            best = Best(matrix, k)
            for pdf in batches:
                if len(pdf):
                    best.add(pdf[ident].to_numpy(), _stack(pdf["__v"]))
            if best.ids is not None:
                yield frame(qs[best.query], best.ids, best.scores)

        scored = rows.mapInPandas(scan, schema)
    else:
        n_rows = rows.count()
        q_blocks = math.ceil(n_queries / _block_size(n_queries, max_broadcast))
        r_blocks = max(1, math.ceil(n_rows / _block_size(n_rows, ROW_BLOCK)))
        a = rows.withColumn("rb", _block(ident, F.lit(r_blocks))).withColumn("qb", _every(F.lit(q_blocks)))
        b = q.withColumn("qb", _block(query_id, F.lit(q_blocks))).withColumn("rb", _every(F.lit(r_blocks)))
        scored = _meeting(a, b, ["rb", "qb"], q_blocks * r_blocks, ident, query_id, k, schema)
    return top_k(scored, [query_id], [F.col("score").desc(), F.col(ident).asc()], k)


def _block_size(n: int, least: int) -> int:
    return max(least, min(MOST_GROWTH * least, n // BLOCKS))


def _block(ident: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(ident), n.cast("bigint")).cast("int")


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))


def _meeting(rows: DataFrame, queries: DataFrame, keys: list[str], tasks: int, ident: str, query_id: str, k: int, schema: str) -> DataFrame:
    """The k best rows (`__v`) of every query (`__q`) within each block of rows and queries with equal keys.

    Where rows have a `list_id` and queries `lists`, a query meets the rows of these lists only, or of all if null. Meetings are long and
    their rows few, so the number of tasks is given.
    """

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({query_id: [], ident: [], "score": []})
        ids, vectors, best = left[ident].to_numpy(), _stack(left["__v"]), Best(_stack(right["__q"]), k)
        if "lists" not in right or right["lists"].isna().all():
            best.add(ids, vectors)
        else:
            here, place = np.unique(left["list_id"].to_numpy(), return_inverse=True)
            probed = np.stack([np.isin(here, lists) for lists in right["lists"]])
            # lists that the same queries probe are shown together
            who, group = np.unique(probed.T, axis=0, return_inverse=True)
            for i, asks in enumerate(who):
                mine = group.ravel()[place] == i
                best.add(ids[mine], vectors[mine], np.flatnonzero(asks))
        if best.ids is None:
            return pd.DataFrame({query_id: [], ident: [], "score": []})
        return pd.DataFrame({query_id: right[query_id].to_numpy()[best.query], ident: best.ids, "score": best.scores})

    left, right = rows.repartition(tasks, *keys), queries.repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)


#: An index is fitted on at most about this many vectors, chosen by their hash; every row is indexed.
TRAIN_ROWS = 50_000


def train_lists(vectors: DataFrame, vector: str, n_lists: int, seed: int = 1, max_iter: int = 20, n_rows: int | None = None) -> KMeansModel:
    share = TRAIN_ROWS / max(n_rows if n_rows is not None else vectors.count(), 1)
    if share < 1:
        vectors = vectors.filter(F.pmod(F.xxhash64(vector, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    features = vectors.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=n_lists, seed=seed, maxIter=max_iter).fit(features)


def assign_lists(vectors: DataFrame, vector: str, model: KMeansModel) -> DataFrame:
    """Add `list_id`, the centre each vector is nearest to."""
    featured = vectors.withColumn("__features", array_to_vector(F.col(vector).cast("array<double>")))
    return model.setFeaturesCol("__features").setPredictionCol("list_id").transform(featured).drop("__features")


def centroid_table(spark, model: KMeansModel) -> DataFrame:
    """Centres as rows; there are about sqrt(n) of them."""
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "list_id int, centroid array<double>")


def probe_top_k(
    indexed: DataFrame, ident: str, vector: str, centroids: DataFrame, queries: DataFrame, query_id: str, query_vector: str, k: int, nprobe: int = 1
) -> DataFrame:
    """Approximate top-k: only rows in the `nprobe` lists nearest to the query are compared.

    Lists, one after another, fill shelves of about a block of rows, and a query travels once to a shelf, with the lists it probes there.
    Where every list is probed, no centre needs to be ranked.
    """
    asking = queries.select(query_id, normalise(F.col(query_vector)).alias("__q"))
    rows = indexed.filter(F.col(vector).isNotNull()).select("list_id", F.col(ident), F.col(vector).alias("__v"))
    schema = f"{query_id} {dict(queries.dtypes)[query_id]}, {ident} {dict(indexed.dtypes)[ident]}, score double"
    n_queries, n_rows = asking.count(), rows.count()
    row_block, query_block = _block_size(n_rows, ROW_BLOCK), _block_size(n_queries, MAX_BROADCAST_QUERIES)
    before = F.sum("__n").over(Window.orderBy("list_id").rowsBetween(Window.unboundedPreceding, -1))  # about sqrt(n) lists
    lists = rows.groupBy("list_id").agg(F.count("*").alias("__n")).withColumn("shelf", F.floor(F.coalesce(before, F.lit(0)) / row_block))
    # a list of more rows is cut into blocks of its own
    lists = lists.select("list_id", "shelf", F.ceil(F.col("__n") / row_block).alias("__r"))
    if nprobe >= centroids.count():
        q_blocks = F.lit(max(1, math.ceil(n_queries / query_block)))
        shelves = lists.groupBy("shelf").agg(F.max("__r").alias("__r")).withColumn("__b", q_blocks)
        probes = asking.withColumn("lists", F.lit(None).cast("array<int>")).crossJoin(F.broadcast(shelves))
    else:
        nearest = exact_top_k(centroids, "list_id", "centroid", queries, query_id, query_vector, nprobe).select(query_id, "list_id")
        probes = nearest.join(lists, "list_id").groupBy(query_id, "shelf").agg(F.collect_list("list_id").alias("lists"), F.max("__r").alias("__r"))
        shelves = probes.groupBy("shelf").agg(F.ceil(F.count("*") / query_block).alias("__b"))
        probes = probes.join(shelves, "shelf").join(asking, query_id)
    a = rows.join(lists, "list_id").join(shelves.select("shelf", "__b"), "shelf").withColumn("rb", _block(ident, F.col("__r"))).withColumn("qb", _every(F.col("__b"))).drop("__r", "__b")
    b = probes.withColumn("qb", _block(query_id, F.col("__b"))).withColumn("rb", _every(F.col("__r"))).select(F.col("shelf").alias("shelf"), "rb", "qb", query_id, "__q", "lists")
    tasks = math.ceil(n_rows / row_block) * math.ceil(n_queries / query_block)
    candidates = _meeting(a, b, ["shelf", "rb", "qb"], max(1, tasks), ident, query_id, k, schema)
    return top_k(candidates, [query_id], [F.col("score").desc(), F.col(ident).asc()], k)


def recall(exact: DataFrame, approximate: DataFrame, query_id: str, ident: str) -> DataFrame:
    """Share of the exact answers the approximate search found, over all queries."""
    hit = approximate.select(query_id, ident).withColumn("__hit", F.lit(1))
    both = exact.select(query_id, ident).join(hit, [query_id, ident], "left")
    return both.agg(F.avg(F.coalesce("__hit", F.lit(0)).cast("double")).alias("recall"))
