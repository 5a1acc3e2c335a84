"""Changes to catalog tables as pure functions: old table and change in, new table out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


class KeyConflict(ValueError):
    """Rows that would break a table's key."""


def latest(source: DataFrame, keys: Sequence[str], place: str | None) -> DataFrame:
    """The last row per key. Without a place, a repeated key raises `KeyConflict`."""
    if place is None:
        again = source.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
        if again:
            raise KeyConflict(f"key {again[0].asDict()} is given more than once")
        return source
    columns = [c for c in source.columns if c not in keys]
    picked = source.groupBy(*keys).agg(F.max_by(F.struct(*columns), place).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in columns if c != place])


def key_conflicts(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that repeat in the source or are taken in the target, with the reason."""
    counted = source.groupBy(*keys).agg(F.count("*").alias("n"))
    repeated = counted.filter("n > 1").select(*keys, F.lit("repeated").alias("reason"))
    taken = counted.join(target.select(*keys), list(keys), "left_semi").select(*keys, F.lit("taken").alias("reason"))
    return repeated.unionByName(taken)


def append_rows(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target and source together; raises `KeyConflict` when a key clashes."""
    clash = key_conflicts(target, source, keys).limit(1).collect()
    if clash:
        raise KeyConflict(f"key {clash[0].asDict()} cannot be appended")
    return target.unionByName(source, allowMissingColumns=True)


def upsert_replace(target: DataFrame, source: DataFrame, keys: Sequence[str], place: str | None = None) -> DataFrame:
    """Source rows replace target rows of the same key as a whole; the last source row of a key counts."""
    fresh = latest(source, keys, place)
    return target.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert_merge(target: DataFrame, source: DataFrame, keys: Sequence[str], place: str | None = None) -> DataFrame:
    """Source values win where they are not null: null means not given, never cleared."""
    fresh = latest(source, keys, place)
    given = [c for c in fresh.columns if c not in keys]
    renamed = fresh.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in given])
    merged = target.join(renamed, list(keys), "full_outer")
    value = lambda c: F.coalesce(F.col(f"__new_{c}"), F.col(c)) if c in given else F.col(c)
    return merged.select(*keys, *[value(c).alias(c) for c in target.columns if c not in keys])


def insert_if_absent(target: DataFrame, source: DataFrame, keys: Sequence[str], place: str | None = None) -> DataFrame:
    """Add the rows whose keys are new; of a repeated source key the last row, or `KeyConflict` without a place."""
    new = latest(source, keys, place).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(new, allowMissingColumns=True)


# The columns each table may have updated.
UPDATABLE = {
    "activity_clusters": ("label", "description", "time_start", "time_end", "location_label", "gps_center_lat", "gps_center_lon", "clip_ids_json", "excluded"),
    "narratives": ("title", "description", "proposed_duration_seconds", "activity_cluster_ids_json", "arc_notes", "emotional_journey", "status"),
    "pipeline_gates": ("mode", "status", "decided_at", "decided_by", "notes", "timeout_hours"),
    "pipeline_jobs": ("stage", "job_type", "target_id", "target_label", "status", "started_at", "finished_at", "duration_seconds", "progress_pct", "error_message", "worker", "run_id"),
    "pipeline_runs": ("started_at", "finished_at", "config_snapshot", "current_stage", "status", "wall_clock_seconds", "budget_remaining_seconds"),
}


def keyed_update(target: DataFrame, patch: DataFrame, keys: Sequence[str], allowed: Iterable[str], place: str | None = None) -> DataFrame:
    """Set the patch's columns on matching rows; a null in the patch clears. Unknown columns raise at once.

    Of a repeated patch key the last row counts, or `KeyConflict` is raised without a place.
    """
    patch = latest(patch, keys, place)
    columns = [c for c in patch.columns if c not in keys]
    bad = sorted(set(columns) - set(allowed))
    if bad:
        raise ValueError(f"Disallowed column(s): {bad}")
    renamed = patch.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = target.join(renamed, list(keys), "left")
    value = lambda c: F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)) if c in columns else F.col(c)
    return joined.select(*[value(c).alias(c) for c in target.columns])


def affected_rows(target: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows of the target the patch touches."""
    return target.join(patch.select(*keys).distinct(), list(keys), "left_semi").agg(F.count("*").alias("affected"))


def set_where(target: DataFrame, condition: Column, **values: object) -> DataFrame:
    return target.withColumns({c: F.when(condition, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def keyed_delete(target: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(doomed.select(*keys).distinct(), list(keys), "left_anti")


def evolve(table: DataFrame, column: str, dtype: str, default: object) -> DataFrame:
    """Add a column with a default; a column that exists is left alone, nulls and all."""
    return table if column in table.columns else table.withColumn(column, F.lit(default).cast(dtype))


def orphans(table: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference is not in the parent table; a null reference is allowed."""
    known = parent.select(F.col(parent_key).alias(column))
    return table.filter(F.col(column).isNotNull()).join(known, column, "left_anti")
