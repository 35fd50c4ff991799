"""Streams with state: any split into batches gives what the whole log gives, late readings are told, restarts repeat nothing."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from halocline.operators import alerts as al
from halocline.plans import inputs
from halocline.streaming import alertfeed as af, readings as st, stateful as sm

SF = "/root/testdata/sf0.001"


def run(spark, frame, path, make, schema, trigger=1):
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", trigger).parquet(f"{path}/in")
    with sm.key_value_store(spark):
        q = make(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out")


def accepted(spark):
    return inputs.readings(spark, SF).withColumn("reason", st.reason()).where("reason is null")


def test_trips_by_stream_and_by_log(spark, tmp_path):
    e = accepted(spark).select("station_id", "seq", "temp_c")
    st.replay_log(e.repartition(5), f"{tmp_path}/in", 150)
    assert len(list((tmp_path / "in").glob("part-*.parquet"))) > 3
    got = sorted((r["station_id"], r["seq"], round(r["delta"], 6)) for r in run(spark, e, tmp_path, sm.trip_stream, sm.TRIPS).collect())
    want = sorted((r["station_id"], r["seq"], round(r["delta"], 6)) for r in st.threshold_alerts(e).where("tripped").collect())
    assert got == want and got


def test_short_look_back_over_many_cells(spark, tmp_path):
    rng = random.Random(4)
    rows = [("a", k, 10 + rng.random() + (30 if k % 211 == 210 else 0)) for k in range(900)]
    e = spark.createDataFrame(rows, "station_id string, seq long, temp_c double")
    st.replay_log(e, f"{tmp_path}/in", 70)
    got = sorted((r["seq"], round(r["delta"], 6)) for r in run(spark, e, tmp_path, lambda s: sm.trip_stream(s, look_back=100), sm.TRIPS).collect())
    ok = st.history(e, look_back=100).withColumn("delta", F.col("temp_c") - F.col("mean_before")).where(st.tripped())
    assert got == sorted((r["seq"], round(r["delta"], 6)) for r in ok.collect()) and len(got) == 4
    cells = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "cells").load()
    assert cells.count() <= 100 // sm.CELL + 2


def test_state_survives_a_restart_and_a_silent_station_begins_anew(spark, tmp_path):
    def part(lo, hi, hot):
        return spark.createDataFrame([("a", k, 90.0 if k == hot else 10.0 + k % 3) for k in range(lo, hi)], "station_id string, seq long, temp_c double")

    for name, pause, want in (("kept", 0, [20]), ("gone", 9, [])):
        path = tmp_path / name
        for lo, hi in ((0, 20), (20, 22)):
            frame = part(lo, hi, 20).coalesce(1)
            frame.write.mode("append").parquet(f"{path}/in")
            found = run(spark, frame, path, lambda s: sm.trip_stream(s, silent_ms=4000 if pause else sm.SILENT_MS), sm.TRIPS)
            if lo == 0 and pause:
                time.sleep(pause)
        assert [r["seq"] for r in found.collect()] == want, name
        assert run(spark, frame, path, lambda s: sm.trip_stream(s, silent_ms=4000 if pause else sm.SILENT_MS), sm.TRIPS).count() == len(want)


@pytest.mark.parametrize("rows", [40, 300])
def test_late_and_on_time_readings_are_all_accepted_ones(spark, tmp_path, rows):
    us = F.unix_micros(F.col("received_at").cast("timestamp"))
    e = accepted(spark).where("seq % 3 = 0").select("station_id", "seq", us.alias("us"), (us + F.col("seq") * 37 % 180 * 60_000_000).alias("arrival"), "temp_c")
    st.replay_log(e, f"{tmp_path}/in", rows, by=("arrival", "seq"))
    out = run(spark, e, tmp_path, sm.hour_stream, sm.HOURS, trigger=2)
    got = {}
    for r in out.unionByName(sm.open_hours(spark, f"{tmp_path}/state")).collect():
        key = (r["station_id"], r["kind"], r["start"])
        assert r["kind"] == "late" or key not in got
        n, total = got.get(key, (0, 0.0))
        got[key] = (n + r["n"], round(total + r["total"], 6))
    want, told, last = {}, {}, {}
    log = sorted(e.collect(), key=lambda r: (r["arrival"], r["seq"]))
    for r in log:
        last[r["station_id"]] = max(r["us"], last.get(r["station_id"], 0))
    for r in log:
        s, start = r["station_id"], r["us"] - r["us"] % sm.HOUR
        end = start + sm.HOUR + sm.LATE
        kind = "late" if end <= told.get(s, 0) else "closed" if end <= last[s] else "open"
        told[s] = max(r["us"], told.get(s, 0))
        n, total = want.get((s, kind, start), (0, 0.0))
        want[s, kind, start] = (n + 1, round(total + r["temp_c"], 6))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(v[1] - want[k][1]) < 1e-4 for k, v in got.items())
    assert sum(v[0] for v in got.values()) == len(log) and {k[1] for k in got} == {"late", "closed", "open"}


def test_watermark_drops_what_hours_call_late(spark, tmp_path):
    """The plain watermarked summary as a stream: readings behind it are gone, all others are summed."""
    t0 = datetime(2024, 1, 1)
    files = [[("a", t0 + timedelta(minutes=m), 1.0) for m in minutes] for minutes in ((1, 2), (300, 301), (302,), (3, 303))]
    schema = "station_id string, ts timestamp, temp_c double"
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = st.tumbling(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    out = spark.read.schema("start timestamp, station_id string, n long, mean double").parquet(f"{tmp_path}/out").collect()
    assert [(r["start"], r["n"]) for r in out] == [(t0, 2)]


# ---- alert feed ------------------------------------------------------------------------------------------------------


def messages(n, seed=1):
    """Alerts, each named by up to three Cancels or Updates, some of identifiers that never come; some messages come twice."""
    rng = random.Random(seed)
    t0, rows = datetime(2024, 1, 1), []
    for k in range(n):
        kind = rng.choices(["Alert", "Update", "Cancel", "Ack", None], [6, 2, 2, 1, 0.3])[0]
        refs = [str(rng.randrange(0, n + 20)) for _ in range(rng.randrange(0, 4))] if kind != "Alert" else None
        sent = t0 + timedelta(hours=k)
        rows.append((str(k), sent, k, rng.choice(["Actual", "Actual", "Exercise", "Test"]), kind, sent, rng.choice([None, sent + timedelta(hours=rng.randrange(1, 90))]), "Severe", "Immediate", refs))
    return rows


def reasons(df):
    return sorted((r["identifier"], r["reason"] or "live") for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_feed_in_any_order_equals_the_batch_view(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(af, "COMPACT", 3)
    rows = messages(150, seed)
    whole = spark.createDataFrame(rows, af.MESSAGES)
    order = list(rows)
    random.Random(seed).shuffle(order)
    path = f"{tmp_path}/table"
    for number in range(5):
        af.upsert(spark.createDataFrame(order[number * 30 : number * 30 + 30] + order[:5], af.MESSAGES), number, path)
    for hours in (0, 70, 149, 400):
        at = datetime(2024, 1, 1) + timedelta(hours=hours)
        got = reasons(af.at_instant(af.latest(spark, path), at))
        assert got == reasons(al.resolved(whole, at))
        assert len({r for _, r in got}) > 3
    drills = reasons(af.at_instant(af.latest(spark, path), datetime(2024, 1, 3), exercises=True))
    assert drills == reasons(al.resolved(whole, datetime(2024, 1, 3), exercises=True))


def test_a_batch_that_runs_again_repeats_nothing(spark, tmp_path):
    path, rows = f"{tmp_path}/table", messages(60)
    frames = [spark.createDataFrame(rows[k::3], af.MESSAGES) for k in range(3)]
    for number, frame in enumerate(frames):
        af.upsert(frame, number, path)
    before = sorted(af.latest(spark, path).collect())
    af.upsert(frames[2], 2, path)
    af.upsert(frames[1], 1, path)  # as after the loss of its commit: later batches stay
    af.upsert(frames[2], 2, path)
    assert sorted(af.latest(spark, path).collect()) == before
    (tmp_path / "table" / "batch" / "n=3").mkdir()  # a batch that was cut off is no part of the table
    assert sorted(af.latest(spark, path).collect()) == before


def test_feed_stream_restarts_where_it_stopped(spark, tmp_path):
    rows = messages(40, 3)
    for k in (1, 0):
        frame = spark.createDataFrame(rows[k::2], af.MESSAGES)
        frame.coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        af.follow(stream, f"{tmp_path}/table", f"{tmp_path}/state").awaitTermination()
    af.follow(stream, f"{tmp_path}/table", f"{tmp_path}/state").awaitTermination()
    assert af._numbers(spark, f"{tmp_path}/table", "batch") == [0, 1, 2, 3]
    at = datetime(2024, 1, 2)
    assert reasons(af.at_instant(af.latest(spark, f"{tmp_path}/table"), at)) == reasons(al.resolved(spark.createDataFrame(rows, af.MESSAGES), at))


def test_empty_table_and_null_fields(spark, tmp_path):
    assert af.latest(spark, f"{tmp_path}/none").count() == 0
    rows = [(None, None, None, None, None, None, None, None, None, ["x"]), ("a", None, None, None, "Cancel", None, None, None, None, ["b", None, "b"]), ("b", None, None, "Actual", "Alert", None, None, None, None, None)]
    af.upsert(spark.createDataFrame(rows, af.MESSAGES), 0, f"{tmp_path}/table")
    assert reasons(af.at_instant(af.latest(spark, f"{tmp_path}/table"), datetime(2024, 1, 1))) == [("a", "not_a_warning"), ("b", "cancelled")]
