"""Reading the event log as a stream, and running a stream over what is there now."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cinelake.session import ensure_checkpoint_dir


def table_glob(folder: str, name: str) -> str:
    """The path of a table that is one file or a folder of files, as a stream may read it: a stream's plain path has to be a folder."""
    if re.search(r"[\\{}\[\]*?]", folder):
        raise ValueError(f"streams read no folder with a pattern's characters in its name: {folder}")
    return f"{folder}/{{{name}}}"


def event_stream(spark: SparkSession, folder: str, schema: StructType | str, pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream. The query's checkpoint takes the place of a reader's cursor."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def events_since(events: DataFrame, cursor: int) -> DataFrame:
    """Batch replay: events after the cursor. Sort by `event_id` to consume them."""
    return events.filter(F.col("event_id") > cursor)


def run_to_table(stream: DataFrame, mode: str, folder: str | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all input available now and return what it wrote, with its `batch`.

    Each micro-batch overwrites its own folder, so a repeated batch changes nothing. A run started again on the
    same folder goes on where the last one stopped.
    """
    spark = stream.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not rows.getFileSystem(spark._jsc.hadoopConfiguration()).exists(rows):
        empty = spark.createDataFrame([], stream.schema)
        return (prepare(empty) if prepare else empty).withColumn("batch", F.lit(0))
    return spark.read.parquet(f"{folder}/rows")


def newest(written: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key that an update-mode stream wrote."""
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])
