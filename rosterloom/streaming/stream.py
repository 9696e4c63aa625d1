"""Streams over the append-only logs, reusing the batch operators.

Each function takes a streaming DataFrame with an event time of type TIMESTAMP.
``land`` runs a query to the end of the available data and into a table.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterable, Iterator, Sequence
from heapq import merge
from itertools import chain, groupby, islice
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from rosterloom.operators.history import apply_status
from rosterloom.operators.stats import STATUSES


def read_log(spark: SparkSession, path: str, time: str = "ts", files_per_batch: int | None = None) -> DataFrame:
    """A file stream of a parquet log; its event time becomes a TIMESTAMP."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # as a pattern the path may be a folder or a single file
    return reader.parquet(f"{path[:-1]}[{path[-1]}]").withColumn(time, F.col(time).cast("timestamp"))


def tumbling_counts(stream: DataFrame, width: str, late: str, by: str, time: str = "ts") -> DataFrame:
    return _windowed(stream, F.window(time, width), late, by, time)


def sliding_counts(stream: DataFrame, width: str, step: str, late: str, by: str, time: str = "ts") -> DataFrame:
    return _windowed(stream, F.window(time, width, step), late, by, time)


def _windowed(stream: DataFrame, window, late: str, by: str, time: str) -> DataFrame:
    counts = stream.withWatermark(time, late).groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n_changes"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n_changes")


def edit_sessions(stream: DataFrame, gap: str, late: str, actor: str, time: str = "ts") -> DataFrame:
    """Bursts of changes of one actor, closed by a pause of ``gap``."""
    sessions = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), actor)
    return sessions.agg(F.count(F.lit(1)).alias("n_changes"), F.min(time).alias("first_at"), F.max(time).alias("last_at")).select(
        actor, "first_at", "last_at", "n_changes"
    )


def dedupe_stream(stream: DataFrame, keys: Sequence[str], late: str, time: str = "ts") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def enrich_stream(stream: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Events with the current dimension; unknown keys keep nulls."""
    return stream.join(dim, key, "left")


def latest_of(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(
        key, *[F.col(f"_r.{c}").alias(c) for c in rest]
    )


FOLD = 16  # batches between two folded tables


def _write_batch(rows: DataFrame, path: str, batch_id: int, fold: int, folded) -> None:
    """Write a batch's rows under its number; every ``fold`` batches also one table of all so far.

    A repeated batch overwrites its own folders and reads only what is before it.
    """
    rows.write.mode("overwrite").parquet(f"{path}/batches/batch={batch_id}")
    if (batch_id + 1) % fold == 0:
        so_far = _batches_before(rows.sparkSession, path, rows.schema, batch_id + 1, fold, batch_id - fold)
        folded(so_far).select(*rows.columns).write.mode("overwrite").parquet(f"{path}/folded/upto={batch_id}")


def _batches_before(spark: SparkSession, path: str, schema: StructType, before: int, fold: int, upto: int | None = None) -> DataFrame:
    """Rows of the last folded table and of the at most ``fold`` batches after it, below ``before``, with their ``batch``."""
    upto = before // fold * fold - 1 if upto is None else upto
    out = spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("bigint"))
    if upto >= 0:
        out = out.unionByName(spark.read.schema(schema).parquet(f"{path}/folded/upto={upto}").withColumn("batch", F.lit(upto).cast("bigint")))
    for b in range(upto + 1, before):
        out = out.unionByName(spark.read.schema(schema).parquet(f"{path}/batches/batch={b}").withColumn("batch", F.lit(b).cast("bigint")))
    return out


def latest_state(stream: DataFrame, path: str, key: str, order: Sequence[str], fold: int = FOLD):
    """Query that keeps the latest row per key in a table.

    Every batch writes its own latest rows; every ``fold`` batches they are folded into one
    table, so a reader opens one table and at most ``fold`` batches however long the stream runs.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(latest_of(batch, key, order), path, batch_id, fold, lambda rows: latest_of(rows.drop("batch"), key, order))

    return stream.writeStream.foreachBatch(write)


def read_latest(spark: SparkSession, path: str, key: str, order: Sequence[str], fold: int = FOLD) -> DataFrame:
    """The latest row per key after all batches written."""
    batches = spark.read.parquet(f"{path}/batches")
    n = batches.agg(F.max("batch")).head()[0] + 1  # from the folders' names
    return latest_of(_batches_before(spark, path, batches.drop("batch").schema, n, fold).drop("batch"), key, order)


def land_stream(stream: DataFrame, path: str):
    """Query that lands every batch with a run record of its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        landed = batch.sparkSession.read.parquet(f"{path}/rows/batch={batch_id}")
        record = landed.agg(F.count(F.lit(1)).alias("inserted")).select(
            F.lit(batch_id).cast("bigint").alias("run_no"), "inserted", F.lit("APPLIED").alias("status")
        )
        record.write.mode("overwrite").parquet(f"{path}/runs/batch={batch_id}")

    return stream.writeStream.foreachBatch(write)


# the processor travels by value, so workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HISTORY = "event_id bigint, person_id bigint, ts timestamp, old_status string, new_status string, ends_role boolean"


CHUNK = 256  # rows of one stored value
FAN = 64  # runs that are merged at once
OUT = 4096  # rows of one result frame
BUCKETS = 256  # groups of persons that share a call; a running stream keeps its number


def _at(row: tuple) -> tuple:
    return row[:4]


class StatusMachine(StatefulProcessor):
    """Per person: the current status and whether the roles are still open.

    A key is a bucket of persons, so calls and frames follow the rows and not the persons; the state is a map by person.
    Rows of a batch come unordered, in frames.  One frame is sorted as it is.  Of a bucket with several, every frame is sorted
    and put into the state as a run of chunks; the runs are merged ``FAN`` at a time, a chunk of each held, and the
    status is carried along the merged rows.  So a person with all rows of a batch needs the memory of a frame.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("status", StringType()), StructField("roles", StringType())])
        self._state = handle.getMapState("status", "person bigint", schema)
        self._runs = handle.getMapState("runs", "run int, chunk int", "rows binary")

    def _put(self, run: int, rows: Iterable[tuple]) -> int:
        rows, n = iter(rows), 0
        while part := list(islice(rows, CHUNK)):
            self._runs.updateValue((run, n), (pickle.dumps(part),))
            n += 1
        return n

    def _take(self, run: int, chunks: int) -> Iterator[tuple]:
        for c in range(chunks):
            (rows,) = self._runs.getValue((run, c))
            self._runs.removeKey((run, c))
            yield from pickle.loads(rows)

    def _ordered(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """(person, time, event_id, status, start) of all frames in order; a status that is none is empty."""

        def rows_of(frame: pd.DataFrame) -> list[tuple]:
            new = frame["new_status"].where(frame["new_status"].isin(STATUSES), "")
            ids = frame["person_id"].tolist(), frame["ts"].astype("int64").tolist(), frame["event_id"].tolist()
            return sorted(zip(*ids, new.tolist(), frame["start_status"].tolist()), key=_at)

        first, second = next(frames), next(frames, None)
        if second is None:
            yield from rows_of(first)
            return
        runs, number = [], 0
        for frame in chain((first, second), frames):
            if len(runs) == FAN:
                merged = self._put(number, merge(*[self._take(*r) for r in runs], key=_at))
                runs, number = [(number, merged)], number + 1
            runs.append((number, self._put(number, rows_of(frame))))
            number += 1
        yield from merge(*[self._take(*r) for r in runs], key=_at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frames = iter(rows)
        first = next(frames)
        kind, out = first["ts"].dtype, []
        names = ["event_id", "person_id", "ts", "old_status", "new_status", "ends_role"]

        def frame() -> pd.DataFrame:
            done = pd.DataFrame(out, columns=names)
            done["ts"] = pd.Series([r[2] for r in out], dtype="int64").astype(kind)
            return done

        for person, changes in groupby(self._ordered(chain((first,), frames)), key=itemgetter(0)):
            known = self._state.getValue((person,))
            status, roles = known or (None, "open")
            for n, (_, ts, event_id, new, start) in enumerate(changes):
                if n == 0 and known is None:
                    status = start
                if new in ("", status):
                    continue
                ends = roles == "open" and new != "ACTIVE"
                out.append((event_id, person, ts, status, new, ends))
                status, roles = new, "ended" if ends else roles
                if len(out) == OUT:
                    yield frame()
                    out = []
            if known is None or (status, roles) != tuple(known):
                self._state.updateValue((person,), (status, roles))
        yield frame()

    def close(self) -> None:
        pass


def status_machine(stream: DataFrame, people: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Valid status changes of a stream (event_id, person_id, ts, new_status), and
    which one ends the person's open roles.  Needs the RocksDB state store."""
    start = people.select("person_id", F.col("status").alias("start_status"))
    rows = stream.join(start, "person_id").select("person_id", "event_id", "ts", "new_status", "start_status")
    bucket = F.pmod(F.xxhash64("person_id"), F.lit(buckets)).alias("_bucket")
    return rows.select(bucket, "*").groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=StatusMachine(), outputStructType=HISTORY, outputMode="append", timeMode="none"
    )


def status_batches(stream: DataFrame, people: DataFrame, path: str, fold: int = FOLD):
    """The same history for logs where one person may hold much of a batch.

    Every batch runs the batch operator, which cuts hot persons by range, on top of
    the state left by earlier batches, folded every ``fold`` of them.  A repeated
    batch overwrites its folders and reads only the state before it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = read_state(spark, path, batch_id, fold)
        known = people.select("person_id", F.col("status").alias("_start")).join(state, "person_id", "left")
        current = known.select("person_id", F.coalesce("status", "_start").alias("status"))
        changes = apply_status(batch, current).withColumn("_at", F.struct("ts", "event_id"))
        ended = state.where("ended").select("person_id")
        first = changes.where("new_status <> 'ACTIVE'").join(ended, "person_id", "left_anti")
        first = first.groupBy("person_id").agg(F.min("_at")["event_id"].alias("_ending"))
        rows = changes.join(first, "person_id", "left").withColumn(
            "ends_role", F.coalesce(F.col("event_id") == F.col("_ending"), F.lit(False))
        )
        rows.drop("_at", "_ending").write.mode("overwrite").parquet(f"{path}/history/batch={batch_id}")
        left = rows.groupBy("person_id").agg(F.max_by("new_status", "_at").alias("status"), F.max("ends_role").alias("ended"))
        _write_batch(left, f"{path}/state", batch_id, fold, _fold_state)

    return stream.writeStream.foreachBatch(write)


STATE = "person_id bigint, status string, ended boolean"


def _fold_state(rows: DataFrame) -> DataFrame:
    return rows.groupBy("person_id").agg(F.max_by("status", "batch").alias("status"), F.max("ended").alias("ended"))


def read_state(spark: SparkSession, path: str, before: int, fold: int = FOLD) -> DataFrame:
    """Status per person after the batches below ``before``."""
    schema = spark.createDataFrame([], STATE).schema
    return _fold_state(_batches_before(spark, f"{path}/state", schema, before, fold))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def land(result: DataFrame, path: str, state: str) -> DataFrame:
    """Run an append query over everything available and return the landed table."""
    query = (
        result.writeStream.outputMode("append").format("parquet").option("checkpointLocation", state)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(path)


def run_to_end(writer, state: str) -> None:
    """Run a foreachBatch query over everything available."""
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
