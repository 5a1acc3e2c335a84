"""Row selections over catalog tables. Plain predicates, so they reach the scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F


def lookup(table: DataFrame, **key: object) -> DataFrame:
    """Rows with the given key values; none is an empty result."""
    return reduce(lambda df, kv: df.filter(F.col(kv[0]) == F.lit(kv[1])), key.items(), table)


def optional_filters(table: DataFrame, **wanted: object) -> DataFrame:
    """As `lookup`, leaving out the arguments that are None."""
    return lookup(table, **{k: v for k, v in wanted.items() if v is not None})


def between(table: DataFrame, column: str, low: object, high: object, **key: object) -> DataFrame:
    """Closed range on a frame number or a second."""
    return lookup(table, **key).filter(F.col(column).between(F.lit(low), F.lit(high)))


def with_vector(table: DataFrame, vector: str, *keep: str) -> DataFrame:
    rows = table.filter(F.col(vector).isNotNull())
    return rows.select(*keep, vector) if keep else rows


def by_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the id table; unknown ids are passed over. Spark broadcasts the ids when small."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def browse_predicate(q: str | None = None, status: str | None = None, date_from: str | None = None, date_to: str | None = None) -> Column:
    """Browse filter. `%` and `_` in `q` are wildcards, the case of A-Z does not matter, dates compare as text."""
    parts: list[Column] = []
    if q:
        folded = F.translate("file_path", ascii_uppercase, ascii_lowercase)
        pattern = q.translate(str.maketrans(ascii_uppercase, ascii_lowercase)).replace("\\", "\\\\")
        parts.append(folded.like(f"%{pattern}%"))
    if status:
        parts.append(F.col("status") == status)
    if date_from:
        parts.append(F.col("created_at") >= date_from)
    if date_to:
        parts.append(F.col("created_at") <= date_to)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def without_binaries(table: DataFrame) -> DataFrame:
    """Drop byte and vector columns from rows meant for display."""
    heavy = [f.name for f in table.schema.fields if f.dataType.simpleString() in ("binary", "array<float>", "array<double>")]
    return table.drop(*heavy)


def project_scope(queue: DataFrame, project: str) -> DataFrame:
    return queue.filter(F.col("group_id").isin(project, f"mem0_{project}"))


def unlabelled_activities(clusters: DataFrame) -> DataFrame:
    """Null and empty labels both count as missing."""
    return clusters.filter(F.coalesce(F.col("label"), F.lit("")) == "")


def unlabelled_faces(clusters: DataFrame) -> DataFrame:
    """Only a null label counts as missing."""
    return clusters.filter(F.col("label").isNull())


def not_excluded(clusters: DataFrame) -> DataFrame:
    return clusters.filter(~F.coalesce(F.col("excluded").cast("boolean"), F.lit(False)))


def with_timestamp(media: DataFrame, column: str = "created_at") -> DataFrame:
    return media.filter(F.col(column).isNotNull())


def not_duplicate(media: DataFrame) -> DataFrame:
    return media.filter(F.coalesce(F.col("status"), F.lit("")) != "duplicate")


def caption_candidates(media: DataFrame, key: str = "id") -> DataFrame:
    """Clips with a duration, as whole-clip intervals (key, 0.0, duration)."""
    length = F.coalesce(F.col("duration_seconds"), F.lit(0.0))
    return media.filter(length > 0).select(key, F.lit(0.0).alias("start_time"), length.alias("end_time"))


def fixed_fraction(df: DataFrame, rate: float, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly max(1, int(n * rate)) rows, the same ones on every run; all of them from rate 1 on.

    Rows are ranked by the MD5 of their key and the seed, joined by colons. Counting the digests in 65,536 ranges finds the range the
    cut falls in, so only that range is ever sorted.
    """
    if rate >= 1.0:
        return df
    place = F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in key), F.lit(str(seed))).cast("binary"))
    span = F.substring(place, 1, 4)
    counts = sorted((r[0], r[1]) for r in df.groupBy(span.alias("span")).count().collect())
    left = max(1, int(sum(n for _, n in counts) * rate))
    for edge, n in counts:
        if n >= left:
            whole = df.filter(span < edge)
            part = df.filter(span == edge).orderBy(place, *key).limit(left)
            return whole.unionByName(part)
        left -= n
    return df
