"""Streams over several batches give the batch result."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rosterloom.operators import history as hs
from rosterloom.streaming import stream as sm

START = dt.datetime(2024, 1, 1)


def write_log(spark, path, n=120, files=4):
    rng = random.Random(2)
    data = [
        (i, i % 5, START + dt.timedelta(minutes=7 * i), rng.choice(["ACTIVE", "RETIRED", "ON LEAVE", "what"])) for i in range(n)
    ]
    df = spark.createDataFrame(data, "event_id long, person_id long, ts timestamp, new_status string")
    size = n // files
    for f in range(files):  # one file per batch, in time order
        df.where((F.col("event_id") >= f * size) & (F.col("event_id") < (f + 1) * size)).coalesce(1).write.mode("append").parquet(path)
    return df


def test_status_machine_equals_batch(spark, rows, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sm.ROCKSDB)
    events = write_log(spark, str(tmp_path / "log"))
    people = spark.createDataFrame([(i, "ACTIVE" if i % 2 else "RETIRED") for i in range(5)], "person_id long, status string")
    log = sm.read_log(spark, str(tmp_path / "log"), files_per_batch=1)
    got = sm.land(sm.status_machine(log, people), str(tmp_path / "out"), str(tmp_path / "state"))
    want = hs.apply_status(events, people)
    cols = ["event_id", "person_id", "old_status", "new_status"]
    assert rows(got, *cols) == rows(want, *cols)
    first = want.where("new_status <> 'ACTIVE'").groupBy("person_id").agg(F.min("event_id"))
    assert rows(got.where("ends_role"), "person_id", "event_id") == rows(first)


def test_a_hot_person_is_sorted_in_runs(spark, rows, tmp_path, monkeypatch):
    """One person with all rows of a batch, out of order, in many frames: runs are merged several times, results stay."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sm.ROCKSDB)
    for name, value in (("CHUNK", 2), ("FAN", 3), ("OUT", 5)):
        monkeypatch.setattr(sm, name, value)
    rng = random.Random(6)
    data = [(i, 1 if i % 10 else 2, START + dt.timedelta(minutes=i), rng.choice(["ACTIVE", "RETIRED", "ON LEAVE", "what"])) for i in range(240)]
    rng.shuffle(data)
    events = spark.createDataFrame(data, "event_id long, person_id long, ts timestamp, new_status string")
    for late in (False, True):  # two batches, the second later in time
        events.where((F.col("event_id") >= 150) == F.lit(late)).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    people = spark.createDataFrame([(1, "ACTIVE"), (2, "RETIRED")], "person_id long, status string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        log = sm.read_log(spark, str(tmp_path / "log"), files_per_batch=1)
        got = sm.land(sm.status_machine(log, people), str(tmp_path / "out"), str(tmp_path / "state"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = hs.apply_status(events, people)
    cols = ["event_id", "person_id", "ts", "old_status", "new_status"]
    assert rows(got, *cols) == rows(want, *cols)
    first = want.where("new_status <> 'ACTIVE'").groupBy("person_id").agg(F.min("event_id"))
    assert rows(got.where("ends_role"), "person_id", "event_id") == rows(first)


def test_a_call_covers_a_bucket_of_persons(spark, rows, tmp_path):
    """Calls follow buckets, not persons; the state is told apart by person, over batches and between buckets of any number."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sm.ROCKSDB)
    events = write_log(spark, str(tmp_path / "log"))
    people = spark.createDataFrame([(i, "ACTIVE" if i % 2 else "RETIRED") for i in range(5)], "person_id long, status string")
    log = sm.read_log(spark, str(tmp_path / "log"), files_per_batch=1)
    want = hs.apply_status(events, people)
    cols = ["event_id", "person_id", "ts", "old_status", "new_status"]
    first = want.where("new_status <> 'ACTIVE'").groupBy("person_id").agg(F.min("event_id"))
    for buckets in (1, 3):
        got = sm.land(sm.status_machine(log, people, buckets), str(tmp_path / f"out{buckets}"), str(tmp_path / f"state{buckets}"))
        assert rows(got, *cols) == rows(want, *cols)
        assert rows(got.where("ends_role"), "person_id", "event_id") == rows(first)


@pytest.mark.parametrize("fold", [2, 16])
def test_status_batches_equal_the_machine(spark, rows, tmp_path, fold):
    events = write_log(spark, str(tmp_path / "log"))
    people = spark.createDataFrame([(i, "ACTIVE" if i % 2 else "RETIRED") for i in range(5)], "person_id long, status string")
    log = sm.read_log(spark, str(tmp_path / "log"), files_per_batch=1)
    sm.run_to_end(sm.status_batches(log, people, str(tmp_path / "t"), fold), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "t" / "history"))
    assert got.select("batch").distinct().count() == 4
    want = hs.apply_status(events, people)
    cols = ["event_id", "person_id", "old_status", "new_status"]
    assert rows(got, *cols) == rows(want, *cols)
    first = want.where("new_status <> 'ACTIVE'").groupBy("person_id").agg(F.min("event_id"))
    assert rows(got.where("ends_role"), "person_id", "event_id") == rows(first)


@pytest.mark.parametrize("fold", [1, 2, 3, 16])
def test_latest_state_over_batches(spark, rows, tmp_path, fold):
    events = write_log(spark, str(tmp_path / "log"), files=7, n=119)
    log = sm.read_log(spark, str(tmp_path / "log"), files_per_batch=1)
    order = ["ts", "event_id"]
    sm.run_to_end(sm.latest_state(log, str(tmp_path / "t"), "person_id", order, fold), str(tmp_path / "state"))
    got = sm.read_latest(spark, str(tmp_path / "t"), "person_id", order, fold)
    want = sm.latest_of(events, "person_id", order)
    assert rows(got, "person_id", "event_id") == rows(want, "person_id", "event_id")
    assert (tmp_path / "t" / "folded").exists() == (fold < 16)
    assert len(got.inputFiles()) <= (fold + 1) * 4  # a reader never opens all batches once they are folded


def test_dedupe_and_windows(spark, tmp_path):
    events = write_log(spark, str(tmp_path / "log"))
    log = sm.read_log(spark, str(tmp_path / "log"), files_per_batch=2)
    twice = log.unionByName(log)
    once = sm.land(sm.dedupe_stream(twice, ["event_id"], "1 hour"), str(tmp_path / "d"), str(tmp_path / "ds"))
    assert once.count() == once.select("event_id").distinct().count() == 120
    counts = sm.land(sm.tumbling_counts(log, "1 hour", "10 minutes", "person_id"), str(tmp_path / "w"), str(tmp_path / "ws"))
    closed = events.agg(F.max("ts") - F.expr("INTERVAL 10 MINUTES")).first()[0]
    want = events.groupBy(F.window("ts", "1 hour").alias("w"), "person_id").count().where(F.col("w.end") <= F.lit(closed))
    assert counts.agg(F.sum("n_changes")).first()[0] == want.agg(F.sum("count")).first()[0]


def test_landing_records_every_batch(spark, tmp_path):
    write_log(spark, str(tmp_path / "log"))
    log = sm.read_log(spark, str(tmp_path / "log"), files_per_batch=1)
    sm.run_to_end(sm.land_stream(log, str(tmp_path / "t")), str(tmp_path / "s"))
    runs = spark.read.parquet(str(tmp_path / "t" / "runs")).collect()
    assert len(runs) == 4 and sum(r.inserted for r in runs) == 120
