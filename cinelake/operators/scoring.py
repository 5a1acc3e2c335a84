"""Running a user's model over rows. No model comes with this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType


def score_batches(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: StructType | str, batch_rows: int = 1024) -> DataFrame:
    """Apply a model loaded once per partition to batches of at most `batch_rows` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = model or load()
            for start in range(0, len(pdf), batch_rows):
                yield model(pdf.iloc[start : start + batch_rows])

    return df.mapInPandas(run, schema)


def score_in_order(df: DataFrame, key: str, order: str, load: Callable[[], Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]], schema: StructType | str) -> DataFrame:
    """Feed each key's rows in order to a stateful model, batch by batch, so a long clip is never held whole.

    Rows are sorted within hash partitions of the key and streamed; a key's rows arrive in consecutive chunks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, model = object(), None
        for pdf in batches:
            for value, chunk in pdf.groupby(key, sort=False, dropna=False):
                value = None if pd.isna(value) else value  # null is a key like any other
                if value != current:
                    current, model = value, load()
                yield from model(iter([chunk]))

    return df.repartition(F.col(key)).sortWithinPartitions(key, order).mapInPandas(run, schema)
