"""Bindings: streams over the event log, each with a batch twin.

Windows and sessions are emitted once the watermark (latest event time less the
allowed lateness) has passed them, so the twins keep only closed ones.
"""

from pyspark.sql import functions as F

from rosterloom.session import run_dir
from rosterloom.streaming import stream as sm

from .bind_history import HISTORY_SQL, STATUS_EVENTS
from .tables import query

LATE = "10 minutes"
CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def _log(t):
    return sm.read_log(t.spark, f"{t.path}/events.parquet")


def _grown(t, run, ranges=4):
    """Let the log grow by a range of time and ``run`` the stream to its end, again and again; the last result."""
    folder, time = run_dir(t.spark, "log"), F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = t.events.agg(F.percentile_approx(time, [i / ranges for i in range(1, ranges)])).head()[0] or []
    out = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        some = t.events.where((time > low) if low is not None else F.lit(True)).where((time <= high) if high is not None else F.lit(True))
        some.write.mode("append").parquet(folder)
        out = run(sm.read_log(t.spark, folder))
    return out


def _land(t, result, label, folder=None):
    folder = folder or run_dir(t.spark, label)
    return sm.land(result, f"{folder}/table", f"{folder}/state")


def _text(df, *cols):
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


@query(
    "n1_tumbling_counts",
    f"""SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS window_start, event_type, count(*) AS n_changes FROM events GROUP BY date_trunc('day', ts), event_type HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {CLOSED}""",
)
def n1(t):
    landed = _land(t, sm.tumbling_counts(_log(t), "1 day", LATE, "event_type"), "tumbling")
    return _text(landed, "window_start").drop("window_end")


@query(
    "n2_sliding_counts",
    f"""WITH w AS (SELECT event_type, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 5 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS s FROM events)
        SELECT CAST(s AS VARCHAR) AS window_start, event_type, count(*) AS n_changes FROM w GROUP BY s, event_type HAVING s + INTERVAL 6 HOUR <= {CLOSED}""",
)
def n2(t):
    landed = _land(t, sm.sliding_counts(_log(t), "6 hours", "1 hour", LATE, "event_type"), "sliding")
    return _text(landed, "window_start").drop("window_end")


@query(
    "n3_edit_sessions",
    f"""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events),
         s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM o)
        SELECT user_id, CAST(min(ts) AS VARCHAR) AS first_at, CAST(max(ts) AS VARCHAR) AS last_at, count(*) AS n_changes FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}""",
)
def n3(t):
    landed = _land(t, sm.edit_sessions(_log(t), "30 minutes", LATE, "user_id"), "sessions")
    return _text(landed, "first_at", "last_at")


@query("n4_dedupe_stream", "SELECT event_id, user_id, event_type, CAST(ts AS VARCHAR) AS ts FROM events")
def n4(t):
    log = _log(t).select("event_id", "user_id", "event_type", "ts")
    doubled = log.unionByName(log.where("event_type IN ('click', 'error')"))
    return _text(_land(t, sm.dedupe_stream(doubled, ["event_id"], LATE), "dedupe"), "ts")


@query(
    "n5_latest_state",
    "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1",
)
def n5(t):
    folder, order = run_dir(t.spark, "latest"), ["ts", "event_id"]

    def run(log):
        rows = log.select("user_id", "ts", "event_id", "event_type", "value")
        sm.run_to_end(sm.latest_state(rows, f"{folder}/table", "user_id", order, fold=3), f"{folder}/state")

    _grown(t, run)
    return sm.read_latest(t.spark, f"{folder}/table", "user_id", order, fold=3).drop("ts")


MACHINE_SQL = HISTORY_SQL + """ SELECT event_id, person_id, CAST(ts AS VARCHAR) AS changed_at, old_status, new_status,
    new_status <> 'ACTIVE' AND row_number() OVER (PARTITION BY person_id, new_status <> 'ACTIVE' ORDER BY ts, event_id) = 1 AS ends_role FROM h"""


def _status_log(t, log):
    return t.spark.sql(STATUS_EVENTS, audit=log.withColumnRenamed("event_type", "action"))


@query("n6_status_machine", MACHINE_SQL)
def n6(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", sm.ROCKSDB)
    folder = run_dir(t.spark, "status")
    landed = _grown(t, lambda log: _land(t, sm.status_machine(_status_log(t, log), t.person), "status", folder))
    return landed.withColumn("changed_at", F.col("ts").cast("string")).drop("ts")


@query("n6_status_batches", MACHINE_SQL)
def n6_batches(t):
    folder = run_dir(t.spark, "status-batches")
    _grown(t, lambda log: sm.run_to_end(sm.status_batches(_status_log(t, log), t.person, folder, fold=3), f"{folder}/checkpoint"))
    landed = t.spark.read.parquet(f"{folder}/history").drop("batch")
    return landed.withColumn("changed_at", F.col("ts").cast("string")).drop("ts")


@query("n7_land_stream", "SELECT CAST(0 AS BIGINT) AS run_no, count(*) AS inserted, 'APPLIED' AS status FROM events")
def n7(t):
    folder = run_dir(t.spark, "landing")
    sm.run_to_end(sm.land_stream(_log(t), folder), f"{folder}/state")
    return t.spark.read.parquet(f"{folder}/runs").drop("batch")


@query(
    "n8_enrich_stream",
    "SELECT e.event_id, e.user_id, e.event_type, c.c_name, c.c_mktsegment FROM events e LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = e.user_id",
)
def n8(t):
    dim = t.customer.where("c_acctbal > 0").selectExpr("c_custkey AS user_id", "c_name", "c_mktsegment")
    log = _log(t).select("event_id", "user_id", "event_type")
    return _land(t, sm.enrich_stream(log, dim, "user_id"), "enrich")
