"""Operators over the event log; most work on a batch DataFrame as well as on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cinelake.functions.documents import flat_event_json
from cinelake.operators.summaries import JOB_STATES, jobs_by_status
from cinelake.schemas import EVENT_TYPES, STAGE_ALIASES


def stage_name(stage: Column) -> Column:
    """One spelling for stages: lower case, with the known aliases."""
    low = F.lower(stage)
    for alias, name in STAGE_ALIASES.items():
        low = F.when(low == alias, name).otherwise(low)
    return low


def flatten(events: DataFrame, payload: str = "payload_json") -> DataFrame:
    """Events as consumers get them: id, type, and one flat JSON document; `known` tells whether the type is listed."""
    return events.select(
        "event_id", "event_type", flat_event_json(F.col("event_type"), F.col("stage"), F.col("job_id").cast("string"), F.col(payload)).alias("data"),
        F.col("event_type").isin(*EVENT_TYPES).alias("known"),
    )


def prune(events: DataFrame, hours: int, now: Column) -> DataFrame:
    """Events of the last `hours` hours."""
    if isinstance(hours, bool) or not isinstance(hours, int) or hours <= 0:
        raise ValueError(f"hours must be a positive integer, got {hours!r}")
    return events.filter(F.col("created_at") >= now - F.expr(f"interval {hours} hours"))


def retained(events: DataFrame, time: str = "created_at", hours: int = 24) -> DataFrame:
    """Give state over the stream the same horizon: rows later than this are dropped."""
    if isinstance(hours, bool) or not isinstance(hours, int) or hours <= 0:
        raise ValueError(f"hours must be a positive integer, got {hours!r}")
    return events.withWatermark(time, f"{hours} hours")


def last_status(events: DataFrame) -> DataFrame:
    """The newest stage and status of each job by event id. Use update mode on a stream."""
    latest = F.max_by(F.struct("stage", "status"), "event_id")
    return events.groupBy("job_id").agg(latest.alias("s"), F.max("event_id").alias("event_id")).select("job_id", "event_id", "s.stage", "s.status")


def live_stage_status(job_states: DataFrame) -> DataFrame:
    return jobs_by_status(job_states)


def _expiring(events: DataFrame, key: str, time: str, keep: str, lateness: str, fold, schema: str, state: str) -> DataFrame:
    """Keyed state that ends: `fold(key, rows, state or None)` gives (state, output rows); a key that is silent for `keep` is forgotten."""
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    names = [part.split()[0] for part in schema.split(", ")]

    def step(keys: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        # A key has a handful of rows per micro-batch, whose size the source limits. Parts of a key number their rows anew.
        rows = pd.concat(list(batches), ignore_index=True)
        new, out = fold(keys[0], rows, held.get if held.exists else None)
        held.update(new)
        due = int(rows[time].max().value // 1_000_000) + keep_ms
        held.setTimeoutTimestamp(max(due, held.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=names)

    return events.withWatermark(time, lateness).groupBy(key).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.EventTimeTimeout)


def stage_changes(events: DataFrame, time: str, keep: str = "24 hours", lateness: str = "10 minutes") -> DataFrame:
    """(stage, status, change, job_id): jobs that a stage and status gains (1) or loses (-1), as they happen; `stage_status` sums them at any time.

    events: job_id, event_id, stage, status and the event time. The newest event id of a job counts. A job that is silent for `keep` stays
    counted where it was, but its state ends; if it reports again it counts as a new job.
    """

    def fold(job, rows: pd.DataFrame, held):
        last = rows.loc[rows["event_id"].idxmax()]
        now = (int(last["event_id"]), last["stage"], last["status"])
        if held is not None and held[0] >= now[0]:
            return held, []
        if held is not None and held[1:] == now[1:]:
            return now, []
        gone = [] if held is None else [(held[1], held[2], -1, job)]
        return now, [*gone, (now[1], now[2], 1, job)]

    kinds = dict(events.dtypes)
    schema = f"stage {kinds['stage']}, status string, change bigint, job_id {kinds['job_id']}"
    return _expiring(events, "job_id", time, keep, lateness, fold, schema, f"event_id bigint, stage {kinds['stage']}, status string")


def stage_status(changes: DataFrame) -> DataFrame:
    """Jobs per stage and status from the changes so far, as `live_stage_status` counts them."""
    n = F.col("change")
    counts = [F.coalesce(F.sum(F.when(F.col("status") == s, n)), F.lit(0)).alias(s) for s in JOB_STATES]
    return changes.groupBy("stage").agg(F.sum(n).alias("total"), *counts).filter("total > 0")


def run_spending(stages: DataFrame, time: str, budget_s: float, keep: str = "48 hours", lateness: str = "10 minutes") -> DataFrame:
    """As `run_budget`, one row per run and micro-batch that adds to it; the state of a run that is silent for `keep` ends."""

    def fold(run, rows: pd.DataFrame, held):
        n, spent = held or (0, 0.0)
        n, spent = n + len(rows), spent + float(rows["elapsed_seconds"].sum())
        return (n, spent), [(run, spent, n, budget_s - spent, spent / budget_s * 100)]

    schema = f"run_id {dict(stages.dtypes)['run_id']}, spent_s double, n_stages bigint, budget_remaining_s double, used_pct double"
    return _expiring(stages, "run_id", time, keep, lateness, fold, schema, "n_stages bigint, spent_s double")


def job_durations(started: DataFrame, finished: DataFrame, within: str = "24 hours", lateness: str = "1 hour") -> DataFrame:
    """Pair each start with its finish. started: job_id, started_at; finished: job_id, finished_at, outcome.

    As a stream join, starts wait for their finish up to `within`; unfinished jobs stay open.
    """
    a = started.withWatermark("started_at", lateness) if started.isStreaming else started
    b = finished.withWatermark("finished_at", lateness) if finished.isStreaming else finished
    b = b.withColumnRenamed("job_id", "__job")
    paired = (F.col("job_id") == F.col("__job")) & (F.col("finished_at") >= F.col("started_at")) & (F.col("finished_at") <= F.col("started_at") + F.expr(f"interval {within}"))
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / F.lit(1e6)
    return a.join(b, paired).select("job_id", "started_at", "finished_at", "outcome", seconds.alias("duration_seconds"))


def run_budget(stages: DataFrame, budget_s: float) -> DataFrame:
    """Time spent per run, what is left of the budget (it may be negative) and the share used."""
    spent = stages.groupBy("run_id").agg(F.sum("elapsed_seconds").alias("spent_s"), F.count("*").alias("n_stages"))
    return spent.withColumns({"budget_remaining_s": F.lit(budget_s) - F.col("spent_s"), "used_pct": F.col("spent_s") / F.lit(budget_s) * 100})


def notifications(events: DataFrame, payload: str = "payload_json") -> DataFrame:
    at = lambda p: F.try_variant_get(F.try_parse_json(payload), p, "string")
    return events.filter("event_type = 'notification'").select("event_id", "stage", at("$.message").alias("message"), at("$.type").alias("kind"))


def unread(events: DataFrame, read_up_to: int) -> DataFrame:
    """One row: notifications after the last one read."""
    return events.filter((F.col("event_type") == "notification") & (F.col("event_id") > read_up_to)).agg(F.count("*").alias("n_unread"))


def tile_scores(scores: DataFrame, time: str, seconds: str = "1 second", lateness: str = "10 seconds") -> DataFrame:
    """Best score of each class per media and tumbling window; rows later than the watermark are dropped."""
    timed = scores.withWatermark(time, lateness) if scores.isStreaming else scores
    return timed.groupBy("media_id", F.window(time, seconds).alias("w"), "class").agg(F.max("probability").alias("probability")).select(
        "media_id", F.col("w.start").alias("tile_start"), "class", "probability"
    )


def tile_top_classes(scores: DataFrame, time: str, k: int, seconds: str = "1 second", lateness: str = "10 seconds") -> DataFrame:
    """The `k` best classes of each media and tumbling window with their ranks, ties by name, once the window is closed (append mode)."""
    timed = scores.withWatermark(time, lateness) if scores.isStreaming else scores
    best = timed.groupBy("media_id", F.window(time, seconds).alias("w"), "class").agg(F.max("probability").alias("probability"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("probability")).alias("minus"), "class")))  # as long as there are classes
    tiles = best.groupBy("media_id", F.window(F.window_time("w"), seconds).alias("v")).agg(F.slice(listed, 1, k).alias("top"))
    return tiles.select("media_id", F.col("v.start").alias("tile_start"), F.posexplode("top").alias("place", "t")).select(
        "media_id", "tile_start", (F.col("place") + 1).alias("rank"), "t.class", (-F.col("t.minus")).alias("probability")
    )


def sliding_means(vectors: DataFrame, time: str, vector: str, length: str = "5 minutes", slide: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Mean vector and count per media and sliding window. Vectors are summed whole. Works in update mode."""
    timed = vectors.withWatermark(time, lateness) if vectors.isStreaming else vectors
    rows = timed.filter(F.col(vector).isNotNull()).select("media_id", time, array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    means = rows.groupBy("media_id", F.window(time, length, slide).alias("w")).agg(Summarizer.mean(F.col("__v")).alias("__m"), F.count("*").alias("n"))
    return means.select("media_id", F.col("w.start").alias("window_start"), vector_to_array("__m").alias("mean_vector"), "n")


def sliding_sums(vectors: DataFrame, time: str, vector: str, length: str = "5 minutes", slide: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Per media, window and dimension: sum and count, from which means follow. Vectors are summed whole and laid out at the end. Works in update mode."""
    timed = vectors.withWatermark(time, lateness) if vectors.isStreaming else vectors
    rows = timed.filter(F.col(vector).isNotNull()).select("media_id", time, array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    sums = rows.groupBy("media_id", F.window(time, length, slide).alias("w")).agg(Summarizer.sum(F.col("__v")).alias("__s"), F.count("*").alias("n"))
    return sums.select("media_id", F.col("w.start").alias("window_start"), F.posexplode(vector_to_array("__s")).alias("dim", "total"), "n").select(
        "media_id", "window_start", "dim", "total", "n"
    )


def session_activities(clips: DataFrame, key: str, time: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Activities by time alone, per camera: a pause of exactly the gap still joins. Append mode emits closed ones."""
    timed = clips.withWatermark(time, lateness) if clips.isStreaming else clips
    return timed.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n_clips"), F.min(time).alias("time_start"), F.max(time).alias("time_end")).select(
        key, "time_start", "time_end", "n_clips"
    )


GATE_SCHEMA = "gate string, decision string, decided_by string, note string, waited_s double"


def _in_order(batches: Iterator[pd.DataFrame], time: str, *columns: str) -> Iterator[tuple]:
    """(seconds, columns) of a key's rows by time, without an object per row. A key has a handful of rows per micro-batch, whose size the source limits."""
    rows = pd.concat(list(batches), ignore_index=True)
    at = rows[time].to_numpy("datetime64[ns]")
    order = np.argsort(at, kind="stable")
    return zip((at[order].astype("int64") / 1e9).tolist(), *(rows[c].to_numpy()[order].tolist() for c in columns))


def gate_decisions(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Outcome of each gate. events: gate, at, kind (arrive, approve, skip), mode, timeout_hours.

    Modes auto and notify let a stage pass as it arrives. In mode pause the gate waits for a decision; with a
    positive timeout it is approved once strictly more time has passed. Waiting gates are kept in state with an
    event-time timer.
    """
    names = [part.split()[0] for part in GATE_SCHEMA.split(", ")]

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate = key[0]
        if state.hasTimedOut:
            _, limit = state.get
            state.remove()
            yield pd.DataFrame([(gate, "approved", "system", "auto-approved: timeout", float(limit))], columns=names)
            return
        since, limit = state.get if state.exists else (None, None)
        out = []
        for at, kind, mode, hours in _in_order(batches, "at", "kind", "mode", "timeout_hours"):
            if since is not None and limit and limit > 0 and at - since > limit:
                out.append((gate, "approved", "system", "auto-approved: timeout", float(limit)))
                since = limit = None
            if kind == "arrive" and since is None:
                if mode == "pause":
                    since, limit = at, (hours or 0.0) * 3600.0
                else:
                    out.append((gate, "approved", "system", None, 0.0))
            elif kind in ("approve", "skip") and since is not None:
                out.append((gate, "approved" if kind == "approve" else "skipped", "user", None, at - since))
                since = limit = None
        if out:
            yield pd.DataFrame(out, columns=names)
        if since is None:
            if state.exists:
                state.remove()
            return
        state.update((since, limit))
        if limit and limit > 0:
            due = int((since + limit) * 1000) + 1
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)

    return events.withWatermark("at", lateness).groupBy("gate").applyInPandasWithState(
        decide, GATE_SCHEMA, "since double, limit double", "append", GroupStateTimeout.EventTimeTimeout
    )


ALERT_SCHEMA = "job_id string, stage string, running_s double"


def stalled_jobs(events: DataFrame, limit_s: float, lateness: str = "10 minutes") -> DataFrame:
    """Jobs still running `limit_s` after their start. events: job_id, stage, at, kind (start, finish)."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            stage, _ = state.get
            state.remove()
            yield pd.DataFrame([(key[0], stage, limit_s)], columns=["job_id", "stage", "running_s"])
            return
        stage, since = state.get if state.exists else (None, None)
        out = []
        for at, kind, name in _in_order(batches, "at", "kind", "stage"):
            if since is not None and at - since > limit_s:
                out.append((key[0], stage, limit_s))
                since = None
            if kind == "start":
                stage, since = name, at
            else:
                since = None
        if out:
            yield pd.DataFrame(out, columns=["job_id", "stage", "running_s"])
        if since is None:
            if state.exists:
                state.remove()
            return
        state.update((stage, since))
        due = int((since + limit_s) * 1000) + 1
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)

    return events.withWatermark("at", lateness).groupBy("job_id").applyInPandasWithState(
        watch, ALERT_SCHEMA, "stage string, since double", "append", GroupStateTimeout.EventTimeTimeout
    )


def gates_near_timeout(waiting: DataFrame, now: Column, share: float = 0.8) -> DataFrame:
    """Waiting gates that have used up more than `share` of their time. waiting: gate, since, timeout_hours."""
    limit = F.col("timeout_hours") * 3600
    waited = (F.unix_micros(now) - F.unix_micros("since")) / F.lit(1e6)
    return waiting.filter((limit > 0) & (waited > limit * share) & (waited <= limit)).withColumn("waited_s", waited)
