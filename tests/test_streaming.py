"""Streams over files that arrive one after the other, against the same rows as a batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cinelake.streaming import events as ev
from cinelake.streaming.source import event_stream, newest, run_to_table, table_glob

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def arriving(spark, path, schema, batches):
    """A stream whose files hold one batch each, read in order."""
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/b{i}")
        time.sleep(0.02)
    return event_stream(spark, f"{path}/in/*", spark.createDataFrame([], schema).schema, files_per_trigger=1)


def test_last_status_over_batches(spark, rows, tmp_path):
    schema = "job_id string, event_id bigint, stage string, status string"
    stream = arriving(spark, tmp_path, schema, [[("a", 1, "ingest", "running"), ("b", 2, "ingest", "running")], [("a", 3, "ingest", "done")]])
    states = newest(run_to_table(ev.last_status(stream), "update", str(tmp_path / "out")), ["job_id"])
    assert rows(states, "job_id", "status") == [("a", "done"), ("b", "running")]


def test_restart_goes_on(spark, rows, tmp_path):
    schema = "event_id bigint"
    stream = arriving(spark, tmp_path, schema, [[(1,), (2,)]])
    run_to_table(stream, "append", str(tmp_path / "out"))
    spark.createDataFrame([(3,)], schema).write.parquet(f"{tmp_path}/in/later")
    again = event_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema, files_per_trigger=1)
    assert rows(run_to_table(again, "append", str(tmp_path / "out")), "event_id") == [(1,), (2,), (3,)]


@pytest.mark.parametrize("hours", [0, -5, 0.5, "24", None, True, False])
def test_retention_arguments(spark, hours):
    df = spark.createDataFrame([(T0,)], "created_at timestamp")
    with pytest.raises(ValueError):
        ev.prune(df, hours, F.current_timestamp())
    with pytest.raises(ValueError):
        ev.retained(df, hours=hours)


def test_prune(spark, rows):
    df = spark.createDataFrame([(1, at(0)), (2, at(7200))], "event_id int, created_at timestamp")
    assert rows(ev.prune(df, 1, F.lit(at(7300))), "event_id") == [(2,)]


def decide(events, mode_timeout):
    """The same gate played by hand, event by event."""
    out, since, limit = [], {}, {}
    for gate, t, kind, mode in sorted(events, key=lambda e: e[1]):
        if gate in since and limit[gate] and t - since[gate] > limit[gate]:
            out.append((gate, "approved", "system"))
            del since[gate]
        if kind == "arrive" and gate not in since:
            if mode == "pause":
                since[gate], limit[gate] = t, mode_timeout
            else:
                out.append((gate, "approved", "system"))
        elif kind in ("approve", "skip") and gate in since:
            out.append((gate, "approved" if kind == "approve" else "skipped", "user"))
            del since[gate]
    return out, since


def test_gates_against_replay(spark, rows, tmp_path):
    rng = random.Random(4)
    events = [(f"g{rng.randint(0, 4)}", i * 60 + rng.randint(0, 50), rng.choice(["arrive", "arrive", "approve", "skip"]), rng.choice(["pause", "notify"])) for i in range(120)]
    batches = [[(g, at(t), k, m, 0.5) for g, t, k, m in events[i : i + 40]] for i in range(0, 120, 40)]
    stream = arriving(spark, tmp_path, "gate string, at timestamp, kind string, mode string, timeout_hours double", batches)
    got = rows(run_to_table(ev.gate_decisions(stream, "1 second"), "append", str(tmp_path / "out")), "gate", "decision", "decided_by")
    want, waiting = decide(events, 1800.0)
    last = max(t for _, t, _, _ in events)
    want += [(g, "approved", "system") for g, t in waiting.items() if t + 1800 < last - 1]
    assert got == sorted(want, key=repr)


def test_stalled_jobs(spark, rows, tmp_path):
    schema = "job_id string, stage string, at timestamp, kind string"
    stream = arriving(spark, tmp_path, schema, [[("a", "asr", at(0), "start"), ("b", "asr", at(0), "start")], [("b", "asr", at(100), "finish"), ("c", "x", at(9000), "start")]])
    assert rows(run_to_table(ev.stalled_jobs(stream, 3600.0, "1 second"), "append", str(tmp_path / "out")), "job_id", "stage") == [("a", "asr")]


def test_durations_leave_open_jobs(spark, rows, tmp_path):
    schema = "job_id string, at timestamp, kind string"
    batches = [[("a", at(0), "start"), ("b", at(5), "start")], [("a", at(65), "finish")]]
    stream = arriving(spark, tmp_path, schema, batches)
    started = stream.filter("kind = 'start'").select("job_id", F.col("at").alias("started_at"))
    finished = stream.filter("kind = 'finish'").select("job_id", F.col("at").alias("finished_at"), F.lit("done").alias("outcome"))
    assert rows(run_to_table(ev.job_durations(started, finished), "append", str(tmp_path / "out")), "job_id", "duration_seconds") == [("a", 65.0)]


def test_sessions_gap_joins(spark, rows, tmp_path):
    schema = "camera string, ts timestamp"
    stream = arriving(spark, tmp_path, schema, [[("c", at(0)), ("c", at(1800)), ("c", at(3601))], [("z", at(90_000))]])
    got = rows(run_to_table(ev.session_activities(stream, "camera", "ts"), "append", str(tmp_path / "out")), "camera", "n_clips")
    assert got == [("c", 1), ("c", 2)]
    batch = spark.createDataFrame([("c", at(0)), ("c", at(1800)), ("c", at(3601))], schema)
    assert rows(ev.session_activities(batch, "camera", "ts"), "n_clips") == [(1,), (2,)]


def test_notifications(spark, rows):
    df = spark.createDataFrame([(1, "notification", "render", '{"message": "m", "type": "error"}'), (2, "job_started", "render", None), (3, "notification", None, "broken")], "event_id bigint, event_type string, stage string, payload_json string")
    assert rows(ev.notifications(df)) == [(1, "render", "m", "error"), (3, None, None, None)]
    assert ev.unread(df, 1).first().n_unread == 1
    assert rows(ev.flatten(df.withColumn("job_id", F.lit("j"))), "event_id", "known") == [(1, True), (2, True), (3, True)]


def test_stage_names(spark):
    df = spark.createDataFrame([("SOURCE_ASSETS",), ("EDL",), ("source",)], "s string")
    assert [r[0] for r in df.select(ev.stage_name(F.col("s"))).collect()] == ["source", "edl", "source"]


def state_rows(stream, tmp_path):
    """Rows that the stream's state holds at its end, and everything it wrote."""
    kept = []
    query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda b, i: kept.extend(b.collect())).start()
    query.awaitTermination()
    return query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"], kept


def test_state_of_finished_jobs_ends(spark, rows, tmp_path):
    schema = "job_id string, event_id bigint, stage string, status string, at timestamp"
    first = [(f"old{i}", i, "ingest", "done", at(i)) for i in range(20)]
    later = [("a", 100, "ingest", "running", at(200_000)), ("b", 101, "ingest", "running", at(200_000))]
    last = [("a", 102, "render", "done", at(300_000)), ("b", 99, "ingest", "error", at(300_000))]
    stream = arriving(spark, tmp_path, schema, [first, later, last])
    left, written = state_rows(ev.stage_changes(stream, "at", keep="30 hours"), tmp_path)
    assert left == 2
    status = ev.stage_status(spark.createDataFrame(written))
    assert rows(status, "stage", "total", "running", "done", "error") == [("ingest", 21, 1, 20, 0), ("render", 1, 0, 1, 0)]


def test_state_of_finished_runs_ends(spark, tmp_path):
    schema = "run_id bigint, elapsed_seconds double, at timestamp"
    stream = arriving(spark, tmp_path, schema, [[(1, 10.0, at(0)), (1, 5.0, at(60))], [(2, 7.0, at(400_000))], [(2, 1.0, at(400_100))]])
    left, written = state_rows(ev.run_spending(stream, "at", 100.0), tmp_path)
    assert left == 1
    assert [(r.run_id, r.spent_s, r.n_stages, r.budget_remaining_s) for r in written] == [(1, 15.0, 2, 85.0), (2, 7.0, 1, 93.0), (2, 8.0, 2, 92.0)]


def test_stage_changes_of_a_key_in_several_arrow_batches(spark, rows, tmp_path):
    schema = "job_id bigint, event_id bigint, stage bigint, status string, at timestamp"
    batch = [(i % 3, i, i % 9, "running" if i % 2 else "done", at(i)) for i in range(90)]
    stream = arriving(spark, tmp_path, schema, [batch])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        changes = run_to_table(ev.stage_changes(stream, "at"), "append", str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert rows(changes, "job_id", "stage", "status", "change") == [(j, (87 + j) % 9, "running" if (87 + j) % 2 else "done", 1) for j in range(3)]


def test_tables_of_one_file_and_of_many_as_streams(spark, rows, tmp_path):
    df = spark.range(10)
    folder = tmp_path / "sf"
    df.repartition(3).write.parquet(str(folder / "many.parquet"))
    df.toPandas().to_parquet(folder / "one.parquet")
    for name in ("many.parquet", "one.parquet"):
        out = run_to_table(event_stream(spark, table_glob(str(folder), name), df.schema), "append")
        assert rows(out, "id") == [(i,) for i in range(10)], name
    with pytest.raises(ValueError):
        table_glob("/data/sf[1]", "one.parquet")


class _Caught:
    """In place of a stream and of a key's state: keeps the function that would run on each key."""

    exists = hasTimedOut = False

    def withWatermark(self, *_):  # noqa: N802
        return self

    def groupBy(self, *_):  # noqa: N802
        return self

    def applyInPandasWithState(self, step, *_):  # noqa: N802
        return step


def test_decisions_of_a_key_leave_in_one_frame(spark):
    import pandas as pd

    at = pd.date_range("2024-01-01", periods=200, freq="s")[::-1]
    kind = ["approve", "arrive"] * 100
    rows = pd.DataFrame({"gate": "g", "at": at, "kind": kind, "mode": "pause", "timeout_hours": 4.0})
    out = list(ev.gate_decisions(_Caught())(("g",), iter([rows[:70], rows[70:]]), _Caught()))
    assert [len(frame) for frame in out] == [100] and set(out[0]["waited_s"]) == {1.0}
    rows = pd.DataFrame({"job_id": "j", "stage": "s", "at": at, "kind": ["finish", "start"] * 100})
    out = list(ev.stalled_jobs(_Caught(), 0.5)(("j",), iter([rows]), _Caught()))
    assert [len(frame) for frame in out] == [100]


def test_rows_of_one_instant_keep_their_order(spark):
    import pandas as pd

    rows = pd.DataFrame({"at": pd.to_datetime([None] + ["2024-01-01 00:00:01"] * 50 + ["2024-01-01 00:00:00"]), "n": range(52)})
    got = list(ev._in_order(iter([rows[:20], rows[20:]]), "at", "n"))
    assert [n for _, n in got] == [51, *range(1, 51), 0] and got[1][0] - got[0][0] == 1.0
