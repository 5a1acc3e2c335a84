"""Keeping the catalog up to date as media arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.plans.ingest import duplicate_pairs
from cinelake.sources.tables import CatalogTables


def ingest_batches(arrivals: DataFrame, catalog: CatalogTables, folder: str) -> None:
    """Add arriving media (columns of `media_files`) to the catalog and mark duplicates.

    Known ids are passed over, so a batch that is run twice changes nothing. Ids order the copies of a batch;
    media already in the catalog always come first.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        known = catalog.read("media_files").select("id", "sha256_prefix")
        fresh = batch.join(known.select("id"), "id", "left_anti").dropDuplicates(["id"])
        met = known.join(fresh.select("sha256_prefix").distinct(), "sha256_prefix", "left_semi")  # what the batch can repeat
        everything = met.select("id", "sha256_prefix").withColumn("__seq", F.struct(F.lit(0).alias("b"), F.col("id").alias("i"))).unionByName(
            fresh.select("id", "sha256_prefix").withColumn("__seq", F.struct(F.lit(1).alias("b"), F.col("id").alias("i")))
        )
        pairs = duplicate_pairs(everything, "sha256_prefix", "id", "__seq").select(F.col("duplicate_id").alias("id"))
        marked = fresh.join(pairs.withColumn("__dup", F.lit(True)), "id", "left")
        status = F.when(F.col("__dup"), "duplicate") if "status" not in fresh.columns else F.when(F.col("__dup"), "duplicate").otherwise(F.col("status"))
        catalog.append("media_files", marked.withColumn("status", status).drop("__dup"))

    query = arrivals.writeStream.option("checkpointLocation", folder).trigger(availableNow=True).foreachBatch(add).start()
    query.awaitTermination()
