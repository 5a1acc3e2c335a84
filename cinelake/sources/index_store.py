"""Vector index on disk: centres, and vectors partitioned by the list they belong to, ids included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_index(indexed: DataFrame, centroids: DataFrame, path: str) -> bool:
    """Write an index; nothing is written when there are no vectors."""
    if indexed.isEmpty():
        return False
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    # Rebalancing keeps a list's files few and splits a list that holds much of the table.
    indexed.hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/vectors")
    return True


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centroids")
