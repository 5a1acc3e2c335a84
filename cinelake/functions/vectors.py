"""Vector arithmetic on `array<float>` / `array<double>` columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(a: Column) -> Column:
    """Unit-length vector; a zero vector stays as it is."""
    norm = l2_norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null when either side is null or has no length."""
    scale = l2_norm(a) * l2_norm(b)
    return F.when(scale > 0, F.lit(1.0) - dot(a, b) / scale)


@F.pandas_udf(ArrayType(FloatType()))
def decode_vectors(blobs: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to an array; null where the length is no multiple of four."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4"))


@F.pandas_udf(BinaryType())
def encode_vectors(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())
