"""Bindings: the batch reconciliation from a document's rows to the load."""

from pyspark.sql import functions as F

from rosterloom.operators import flow
from rosterloom.session import durable, run_dir
from rosterloom.sources import commit

from .tables import query

# a directory document per fifth of the organizations: a title, a header, people and control rooms each, and a section of vendors
DOCUMENT = """
    SELECT org_id % 5 AS doc_id, org_id * 1000000000 AS row_no, CAST(1 + org_id AS STRING) || '. ' || org_name AS row_text FROM {org} WHERE org_id < 25
    UNION ALL SELECT org_id % 5, org_id * 1000000000 + 1, 'Name|Designation|Mobile' FROM {org} WHERE org_id < 25
    UNION ALL SELECT listed % 5, listed * 1000000000 + 100000000 + person_id, ' ' || person_name || ' |' || title || '|' || COALESCE(mobile, '')
      FROM (SELECT person_id, person_name, title, mobile, CASE WHEN balance BETWEEN 7000 AND 7400 THEN (org_id + 1) % 25 ELSE org_id END AS listed FROM {person} WHERE balance > 300)
    UNION ALL SELECT org_id % 5, org_id * 1000000000 + 500000000 + place_id, label || '|Control Room|' || phone FROM {place} WHERE category = 'Control Room' AND org_id < 25 AND place_id % 4 <> 0
    UNION ALL SELECT 0, 900000000000, '99. Vendors and others'
    UNION ALL SELECT 0, 900000000001 + head_id, role_title || ' of ' || CAST(head_id AS STRING) || '|Agent|' || mobile FROM {head}"""
STORED = """
    SELECT o.org_name AS station, 'Employee' AS category, p.person_name AS name FROM {person} p JOIN {org} o ON o.org_id = p.org_id
    UNION ALL SELECT o.org_name, 'Control Room', CASE WHEN p.place_id % 3 = 0 THEN replace(p.label, ' ', '-') ELSE p.label END FROM {place} p JOIN {org} o ON o.org_id = p.org_id WHERE p.category = 'Control Room' AND p.org_id < 25"""
DECIDED = "SELECT lower(person_name) AS name_key, CASE person_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'skipped' END AS decision FROM {person} WHERE balance BETWEEN 7000 AND 7400"

FINDINGS_SQL = f"""WITH a AS (SELECT o.org_name AS station, 'Employee' AS category, p.person_name AS name FROM {{person}} p JOIN {{org}} o ON o.org_id = CASE WHEN balance BETWEEN 7000 AND 7400 THEN (p.org_id + 1) % 25 ELSE p.org_id END WHERE balance > 300
         UNION ALL SELECT o.org_name, 'Control Room', p.label FROM {{place}} p JOIN {{org}} o ON o.org_id = p.org_id WHERE p.category = 'Control Room' AND p.org_id < 25 AND p.place_id % 4 <> 0),
    b AS ({STORED}), k AS (SELECT station, category, lower(trim(name)) AS k, min(name) AS name, count_if(side = 'a') AS na, count_if(side = 'b') AS nb FROM (SELECT *, 'a' AS side FROM a UNION ALL SELECT *, 'b' FROM b) GROUP BY 1, 2, 3),
    f AS (SELECT *, row_number() OVER (ORDER BY station, category, k, issue) AS id, trim(regexp_replace(k, '[^a-z0-9]+', ' ', 'g')) AS words FROM (
      SELECT *, 'Missing' AS issue FROM k WHERE nb = 0 UNION ALL SELECT *, 'Extra' FROM k WHERE na = 0 UNION ALL SELECT *, 'Duplicate' FROM k WHERE nb > 1)),
    n AS (SELECT *, row_number() OVER (PARTITION BY station, category, issue, words ORDER BY id) AS nth FROM f WHERE category = 'Control Room'),
    ar AS (SELECT m.id AS missing_id, e.id AS extra_id FROM n m JOIN n e ON m.issue = 'Missing' AND e.issue = 'Extra' AND m.station = e.station AND m.words = e.words AND m.nth = e.nth),
    st AS (SELECT f.*, CASE WHEN id IN (SELECT missing_id FROM ar) OR id IN (SELECT extra_id FROM ar) THEN 'naming difference' ELSE 'open' END AS status FROM f)"""


def _tables(t):
    return {n: getattr(t, n) for n in ("org", "person", "place", "head")}


def _flow(t):
    some = _tables(t)
    rows = t.spark.sql(DOCUMENT, **some).withColumn("cells", F.split("row_text", r"\|"))
    stored = durable(t.spark.sql(STORED, **{n: some[n] for n in ("org", "person", "place")}))
    return flow.reconcile_directory(rows, "doc_id", "row_no", "cells", t.org, stored, _decisions(t))


def _decisions(t):
    return t.spark.sql(DECIDED, person=t.person)


@query("flow_findings", FINDINGS_SQL + " SELECT id AS finding_id, station, category, issue, name, status FROM st")
def findings(t):
    return _flow(t).findings.select("finding_id", "station", "category", "issue", "name", "status")


@query(
    "flow_stations",
    FINDINGS_SQL + " SELECT station, 'perfect' AS outcome FROM (SELECT DISTINCT station FROM a) WHERE station NOT IN (SELECT station FROM st WHERE status = 'open') UNION ALL SELECT 'vendors and others', 'no station'",
)
def stations(t):
    done = _flow(t)
    return done.perfect.select("station", F.lit("perfect").alias("outcome")).unionByName(done.skipped.select(F.col("title").alias("station"), F.lit("no station").alias("outcome")))


@query(
    "flow_moves",
    FINDINGS_SQL + f""", d AS ({DECIDED}), m AS (SELECT k, count_if(issue = 'Missing') AS m, count_if(issue = 'Extra') AS e, min(CASE WHEN issue = 'Missing' THEN station END) AS t, min(CASE WHEN issue = 'Extra' THEN station END) AS s
        FROM st WHERE category = 'Employee' AND issue <> 'Duplicate' GROUP BY 1)
      SELECT k AS name_key, CASE WHEN m > 0 AND e > 0 THEN 'move' ELSE 'ignore' END AS action, CASE WHEN m = 1 AND e = 1 THEN 'HIGH' WHEN m > 0 AND e > 0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
        CASE WHEN m = 1 AND e = 1 THEN s END AS from_station, CASE WHEN m = 1 AND e = 1 THEN t END AS to_station, m > 0 AND e > 0 AND k NOT IN (SELECT name_key FROM d WHERE decision IN ('approved', 'rejected')) AS waiting FROM m""",
)
def moves(t):
    done = _flow(t)
    waiting = done.open_moves.select("name_key", F.lit(True).alias("waiting"))
    return done.moves.join(waiting, "name_key", "left").select(
        "name_key", "action", "confidence", "from_station", "to_station", F.coalesce("waiting", F.lit(False)).alias("waiting")
    )


@query(
    "flow_loaded",
    """SELECT person_id, person_name, o.org_name FROM {person} p JOIN {org} o ON o.org_id = CASE WHEN balance BETWEEN 7000 AND 7400 AND person_id % 3 = 0 THEN (p.org_id + 1) % 25 ELSE p.org_id END""",
)
def loaded(t):
    people = t.person.join(t.org.select("org_id", "org_name"), "org_id").select("person_id", "person_name", "org_name")
    path = run_dir(t.spark, "flow")
    flow.load_decided(_flow(t), people, "person_id", "person_name", "org_name", _decisions(t), path, "directory")
    return commit.read_owners(t.spark, path, "person_id bigint, person_name string, org_name string")
