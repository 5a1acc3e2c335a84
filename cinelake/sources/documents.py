"""Documents out of rows: one folder per document, lines in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cinelake.functions.checks import asset_priority, asset_sources
from cinelake.functions.text import fill, fixed
from cinelake.functions.timecode import srt_stamp

# The head of the fetch list.
FETCH_LIST_HEAD = (
    "# Unresolved Asset Fetch List",
    "",
    "| Type | Description | Start Time | Duration | Suggested Sources | Priority |",
    "| --- | --- | --- | --- | --- | --- |",
)


def fetch_list_line(kind: Column, description: Column, start_time: Column, duration: Column) -> Column:
    return fill("| {} | {} | {} | {}s | {} | {} |", kind, description, start_time, fixed(duration, 1), asset_sources(kind), asset_priority(kind, duration))


def srt_cue(number: Column, start: Column, end: Column, text: Column) -> Column:
    """One subtitle cue with the blank line that ends it."""
    return fill("{}\n{} --> {}\n{}\n", number, srt_stamp(start), srt_stamp(end), text)


def write_lines(lines: DataFrame, document: str, order: list[str], text: str, path: str, partitions: int | None = None) -> None:
    """Write each document's lines as text under `path/<document>=...`, part files in line order.

    Rows are range-partitioned by (document, order), so a long document is written by many tasks and its
    sorted part files joined give the whole text.
    """
    keys = [document, *order]
    spread = lines.repartitionByRange(partitions, *keys) if partitions else lines.repartitionByRange(*keys)
    spread.sortWithinPartitions(*keys).select(document, F.col(text).alias("value")).write.mode("overwrite").partitionBy(document).text(path)


def write_reports(reports: DataFrame, document: str, path: str) -> None:
    """Write each row as a JSON report under `path/<document>=...`."""
    reports.write.mode("overwrite").partitionBy(document).json(path)
