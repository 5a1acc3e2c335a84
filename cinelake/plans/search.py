"""Vector index and search."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from cinelake.operators.vector_search import assign_lists, centroid_table, exact_top_k, probe_top_k, train_lists


def build_index(vectors: DataFrame, vector: str, seed: int = 1, max_iter: int = 20) -> tuple[DataFrame, DataFrame]:
    """(vectors with list_id, centres), with about sqrt(n) lists, two at least, fitted on a bounded sample of the vectors. Whether to search by index or exactly is the caller's choice."""
    n = vectors.count()
    if n == 0:
        return vectors.withColumn("list_id", F.lit(0)), vectors.sparkSession.createDataFrame([], "list_id int, centroid array<double>")
    model = train_lists(vectors, vector, max(2, int(math.sqrt(n))), seed, max_iter, n)
    return assign_lists(vectors, vector, model), centroid_table(vectors.sparkSession, model)


def search(vectors: DataFrame, ident: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int = 10, index: tuple[DataFrame, DataFrame] | None = None, nprobe: int = 1) -> DataFrame:
    """Top k per query: exact without an index, else over the nearest lists."""
    if index is None:
        return exact_top_k(vectors, ident, vector, queries, query_id, query_vector, k)
    indexed, centroids = index
    return probe_top_k(indexed, ident, vector, centroids, queries, query_id, query_vector, k, nprobe)
