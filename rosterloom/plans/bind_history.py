"""Bindings: history, versions and audit."""

from datetime import datetime

from pyspark.sql import functions as F

from rosterloom.operators import history as hs
from rosterloom.operators.rank import resolve_heads
from rosterloom.operators.stats import directory_rows
from rosterloom.session import run_dir

from .bind_search import VERSIONS
from .bind_stats import DIRECTORY_SQL
from .tables import query

STATUS_EVENTS = """SELECT event_id, user_id AS person_id, ts, CASE action WHEN 'signup' THEN 'ACTIVE' WHEN 'purchase' THEN 'ACTIVE' WHEN 'view' THEN 'TRANSFERRED' WHEN 'click' THEN 'ON LEAVE' ELSE 'UNKNOWN' END AS new_status FROM {audit}"""
HISTORY_SQL = f"""WITH e AS (SELECT * FROM ({STATUS_EVENTS}) WHERE new_status <> 'UNKNOWN'), s AS (SELECT e.*, COALESCE(lag(new_status) OVER (PARTITION BY e.person_id ORDER BY ts, event_id), p.status) AS old_status FROM e JOIN {{person}} p ON p.person_id = e.person_id),
    h AS (SELECT event_id, person_id, ts, old_status, new_status FROM s WHERE old_status <> new_status)"""


def status_events(t):
    return t.spark.sql(STATUS_EVENTS, audit=t.audit)


@query("m8_apply_status", HISTORY_SQL + " SELECT event_id, person_id, CAST(ts AS VARCHAR) AS changed_at, old_status, new_status FROM h")
def m8(t):
    changes = hs.apply_status(status_events(t), t.person)
    return changes.withColumn("changed_at", F.col("ts").cast("string")).drop("ts")


@query(
    "m8_end_roles",
    HISTORY_SQL + """, f AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY ts, event_id) AS rn FROM h WHERE new_status <> 'ACTIVE')
       SELECT d.head_id, d.person_id, f.event_id, 'status changed to ' || f.new_status AS reason FROM {head} d JOIN f ON f.person_id = d.person_id AND f.rn = 1""",
)
def m8_roles(t):
    return hs.end_roles(hs.apply_status(status_events(t), t.person), t.head)


STATES = """SELECT request_id, person_id, CASE WHEN status = 'PENDING' THEN 'A' ELSE 'B' END AS org, CASE WHEN new_value IS NULL THEN 'clerk' ELSE field_name END AS title, status FROM {request}"""


def _diff(c):
    return f"CASE WHEN b_{c} IS DISTINCT FROM {c} THEN b_{c} END AS old_{c}, CASE WHEN b_{c} IS DISTINCT FROM {c} THEN {c} END AS new_{c}"


@query(
    "m9_timeline",
    f"""WITH s AS (SELECT *, lag(org) OVER w AS b_org, lag(title) OVER w AS b_title, lag(status) OVER w AS b_status, row_number() OVER w AS rn FROM ({STATES}) WINDOW w AS (PARTITION BY person_id ORDER BY request_id))
        SELECT person_id, request_id, {_diff('org')}, {_diff('title')}, {_diff('status')} FROM s WHERE rn > 1 AND (b_org IS DISTINCT FROM org OR b_title IS DISTINCT FROM title OR b_status IS DISTINCT FROM status)""",
)
def m9(t):
    return hs.timeline(t.spark.sql(STATES, request=t.request), "person_id", ["request_id"], ["org", "title", "status"])


@query(
    "m10_single_flag",
    """WITH e AS (SELECT p.org_id, p.person_id, r.request_id FROM {request} r JOIN {person} p ON p.person_id = r.person_id WHERE r.status = 'APPROVED'), l AS (SELECT org_id, person_id FROM (SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY request_id DESC) rn FROM e) WHERE rn = 1)
       SELECT p.person_id, p.org_id, COALESCE(l.person_id = p.person_id, FALSE) AS is_primary FROM {person} p LEFT JOIN l ON l.org_id = p.org_id""",
)
def m10(t):
    people = t.person.select("person_id", "org_id")
    events = t.request.where("status = 'APPROVED'").join(people, "person_id")
    return hs.single_flag(people, "org_id", "person_id", events, ["request_id"])


@query(
    "m11_number_versions",
    f"""WITH v AS ({VERSIONS}), x AS (SELECT year, month, count(*) AS have FROM v WHERE status = 'ARCHIVED' AND month < 7 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY year, month ORDER BY version_id) AS rn FROM v WHERE status <> 'ARCHIVED')
        SELECT r.version_id AS request_id, r.year, r.month, version_number || CASE WHEN rn + COALESCE(have, 0) > 1 THEN '.' || CAST(rn + COALESCE(have, 0) AS VARCHAR) ELSE '' END AS version_number FROM r LEFT JOIN x ON x.year = r.year AND x.month = r.month""",
)
def m11(t):
    versions = t.spark.sql(VERSIONS, orders=t.orders)
    requests = versions.where("status <> 'ARCHIVED'").selectExpr("version_id AS request_id", "year", "month")
    return hs.number_versions(requests, versions.where("status = 'ARCHIVED' AND month < 7"))


@query(
    "m12_publish_snapshot",
    f"SELECT section, count(*) AS n_rows, count(DISTINCT org_name) AS n_orgs, '2024.05' AS version FROM ({DIRECTORY_SQL}) GROUP BY 1",
)
def m12(t):
    rows = directory_rows(t.org, t.person, t.place, resolve_heads(t.person, t.org))
    return hs.publish_snapshot(rows, run_dir(t.spark, "snapshots"), "2024.05")


AT = datetime(2024, 5, 31, 12)


def _versions(t):
    rows, path = directory_rows(t.org, t.person, t.place, resolve_heads(t.person, t.org)), run_dir(t.spark, "versions")
    first = hs.publish_version(rows, path, 2024, 5, AT, actor=7, remarks="monthly")
    hs.publish_version(rows.where("org_name <> 'NATION_3'"), path, 2024, 5, AT, actor=7, regenerate=True)
    hs.publish_version(rows, path, 2024, 6, AT)
    hs.delete_version(t.spark, path, first, AT, actor=8)
    return path


@query(
    "m12_version_records",
    f"""WITH d AS ({DIRECTORY_SQL}), a AS (SELECT count(*) AS n_rows, count(DISTINCT org_name) AS n_orgs FROM d), b AS (SELECT count(*) AS n_rows, count(DISTINCT org_name) AS n_orgs FROM d WHERE org_name <> 'NATION_3')
        SELECT '2024.05' AS version, 5 AS month, 'monthly' AS remarks, n_rows, n_orgs, 'DELETED' AS status FROM a UNION ALL SELECT '2024.05.2', 5, NULL, n_rows, n_orgs, 'GENERATED' FROM b UNION ALL SELECT '2024.06', 6, NULL, n_rows, n_orgs, 'GENERATED' FROM a""",
)
def m12_records(t):
    return hs.version_records(t.spark, _versions(t)).select("version", "month", "remarks", "n_rows", "n_orgs", "status")


@query(
    "m12_version_audit",
    f"""WITH d AS (SELECT count(*) AS n FROM ({DIRECTORY_SQL})), x AS (SELECT '2024.05' AS record, 'GENERATE' AS action, NULL AS old_value, '2024.05' AS new_value, 7 AS actor UNION ALL SELECT '2024.05.2', 'REGENERATE', NULL, '2024.05.2', 7
          UNION ALL SELECT '2024.06', 'GENERATE', NULL, '2024.06', NULL UNION ALL SELECT '2024.05', 'DELETE', '2024.05', NULL, 8)
        SELECT record, action, old_value, new_value, CAST(actor AS BIGINT) AS actor FROM x, d WHERE n > 0""",
)
def m12_audit(t):
    return hs.version_audit(t.spark, _versions(t)).select("record", "action", "old_value", "new_value", "actor")


@query(
    "m12_version_rows",
    f"SELECT section, org_name, count(*) AS n_rows FROM ({DIRECTORY_SQL}) WHERE org_name <> 'NATION_3' GROUP BY 1, 2",
)
def m12_rows(t):
    rows = hs.version_rows(t.spark, _versions(t), "2024.05.2")
    return rows.groupBy("section", "org_name").agg(F.count(F.lit(1)).alias("n_rows"))


V0 = "SELECT CASE WHEN request_id % 50 <> 7 THEN request_id END AS request_id, CASE WHEN request_id % 50 = 7 THEN new_value || CAST(request_id AS STRING) END AS part, person_id, status, new_value, field_name FROM {request}"
V1 = f"SELECT request_id, part, person_id, status, new_value FROM ({V0}) WHERE field_name <> 'address'"
V2 = f"SELECT request_id, part, person_id, CASE WHEN person_id < 100 THEN 'CLOSED' ELSE status END AS status, new_value FROM ({V0}) WHERE status <> 'REJECTED'"


@query(
    "m13_snapshot_diff",
    f"""SELECT COALESCE(a.request_id, b.request_id) AS request_id, COALESCE(a.part, b.part) AS part, CASE WHEN a.person_id IS NULL THEN 'added' WHEN b.person_id IS NULL THEN 'removed' ELSE 'changed' END AS change, a.status AS old_status, b.status AS new_status, a.new_value AS old_new_value, b.new_value AS new_new_value
        FROM ({V1}) a FULL JOIN ({V2}) b ON a.request_id IS NOT DISTINCT FROM b.request_id AND a.part IS NOT DISTINCT FROM b.part
        WHERE a.person_id IS NULL OR b.person_id IS NULL OR a.status IS DISTINCT FROM b.status OR a.new_value IS DISTINCT FROM b.new_value""",
)
def m13(t):
    v1, v2 = t.spark.sql(V1, request=t.request), t.spark.sql(V2, request=t.request)
    return hs.snapshot_diff(v1, v2, ["request_id", "part"], ["status", "new_value"])


@query("m14_audit_counts", "SELECT user_id, action, count(*) AS n_changes, CAST(min(ts) AS VARCHAR) AS first_at, CAST(max(ts) AS VARCHAR) AS last_at FROM {audit} GROUP BY 1, 2")
def m14(t):
    counts = hs.audit_counts(t.audit, ["user_id", "action"])
    return counts.withColumns({c: F.col(c).cast("string") for c in ("first_at", "last_at")})


@query("m14_audit_last", "SELECT user_id, action, max_by(value, event_id) AS last_value FROM {audit} GROUP BY 1, 2")
def m14_last(t):
    return hs.audit_last(t.audit, ["user_id", "action"], ["event_id"], "value")
