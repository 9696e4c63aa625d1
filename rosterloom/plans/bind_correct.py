"""Bindings: corrections."""

from pyspark.sql import functions as F

from rosterloom.functions import text as tx
from rosterloom.operators import correct as cr

from .bind_reconcile import ENTITY_SQL, FOLD, WRONG_SQL
from .tables import query

PROPOSE_SQL = ENTITY_SQL.split(", j AS (")[0] + ", j AS (SELECT a.org_id, a.k, b.person_id AS row_id, " + ENTITY_SQL.split(", j AS (SELECT a.org_id, a.k, ")[1].split(",\n      i AS (")[0] + """,
    pr AS (SELECT a.org_id, a.k, CAST(NULL AS BIGINT) AS row_id, '(record)' AS field, 'insert' AS action, NULL AS old_value, NULL AS new_value, 'High' AS confidence FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.org_id IS NOT DISTINCT FROM a.org_id AND b.k = a.k)
      UNION ALL SELECT org_id, k, row_id, 'title', 'update', tb, ta, 'High' FROM j WHERE lower(ta) <> lower(tb)
      UNION ALL SELECT org_id, k, row_id, 'mobile', 'fill', NULL, pa, 'High' FROM j WHERE pa <> '' AND pb = '' UNION ALL SELECT org_id, k, row_id, 'mobile', 'manual', pb, pa, 'Low' FROM j WHERE pa <> '' AND pb <> '' AND pa <> pb
      UNION ALL SELECT org_id, k, row_id, 'email', 'fill', NULL, ea, 'High' FROM j WHERE ea <> '' AND eb = ''
      UNION ALL SELECT org_id, k, row_id, 'email', CASE WHEN contains(eb, ', ') THEN 'manual' ELSE 'update' END, eb, ea, CASE WHEN contains(eb, ', ') THEN 'Low' ELSE 'High' END FROM j WHERE ea <> '' AND eb <> '' AND ea <> eb)"""


def _propose(t):
    key = tx.folded(F.col("person_name"))
    a, b = t.src_a.withColumn("k", key), t.src_b.withColumn("k", key)
    return cr.propose(a, b, ["org_id", "k"], "person_id", "person_id", "title", "mobile", "email")


@query("m1_propose", PROPOSE_SQL + " SELECT * FROM pr")
def m1(t):
    return _propose(t)


REMAP_A = """SELECT CASE WHEN title = 'Liaison' THEN 1000 + org_id % 5 ELSE org_id END AS org_id, person_name FROM {src_a}"""


@query(
    "m2_propose_remap",
    f"""WITH a AS (SELECT DISTINCT org_id, {FOLD % 'person_name'} AS k FROM ({REMAP_A})), w AS (SELECT k, count(*) AS n, min(org_id) AS o FROM a GROUP BY 1), b AS (SELECT *, {FOLD % 'person_name'} AS k FROM {{src_b}}),
         x AS (SELECT b.person_id, w.o, t.parent_id FROM b JOIN w ON w.k = b.k AND w.n = 1 JOIN {{org}} t ON t.org_id = w.o WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.org_id IS NOT DISTINCT FROM b.org_id AND a.k = b.k))
        SELECT person_id AS row_id, 'child_id' AS field, CASE WHEN parent_id IS NOT NULL THEN CAST(o AS VARCHAR) END AS new_value FROM x UNION ALL SELECT person_id, 'parent_id', CAST(COALESCE(parent_id, o) AS VARCHAR) FROM x""",
)
def m2(t):
    return cr.propose_remap(t.spark.sql(REMAP_A, src_a=t.src_a), t.src_b, "person_name", "person_id", t.org)


CHANGES = """SELECT CAST(o_custkey AS BIGINT) AS row_id, CAST(o_orderkey AS BIGINT) AS change_id,
    CASE WHEN o_orderstatus = 'O' THEN 'update' WHEN o_orderstatus = 'F' THEN 'manual' WHEN o_totalprice < 20000 THEN 'delete' WHEN o_totalprice > 480000 THEN 'insert' ELSE 'manual' END AS action,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'label' WHEN '2-HIGH' THEN 'org_id' WHEN '3-MEDIUM' THEN 'station' WHEN '4-NOT SPECIFIED' THEN 'colour' ELSE 'price' END AS field,
    CASE WHEN o_totalprice < 30000 THEN 'x' || CAST(o_orderkey AS STRING) WHEN o_totalprice > 470000 THEN NULL ELSE CAST(o_orderkey AS STRING) END AS new_value FROM {orders}"""
STORED = "SELECT place_id, label, station, org_id, price FROM {place} WHERE org_id < 24"
APPLY_SQL = f"""WITH c AS ({CHANGES}), t AS ({STORED}), x AS (SELECT c.*, t.place_id IS NOT NULL AS there, CASE field WHEN 'org_id' THEN new_value IS NULL OR TRY_CAST(new_value AS BIGINT) IS NOT NULL WHEN 'price' THEN new_value IS NULL OR TRY_CAST(new_value AS DOUBLE) IS NOT NULL ELSE TRUE END AS fits
      FROM c LEFT JOIN t ON t.place_id = c.row_id WHERE action <> 'manual'),
    y AS (SELECT *, CASE WHEN action <> 'insert' AND NOT there THEN 'row not found' WHEN action <> 'delete' AND field = 'colour' THEN 'unknown field' WHEN action <> 'delete' AND NOT fits THEN 'value does not fit' END AS problem FROM x),
    g AS (SELECT *, row_number() OVER (PARTITION BY row_id, action, field ORDER BY change_id DESC) AS rn FROM y WHERE problem IS NULL),
    u AS (SELECT row_id, action, """ + ", ".join(
    f"max(CASE WHEN field = '{c}' THEN 1 ELSE 0 END) AS c_{c}, max(CASE WHEN field = '{c}' THEN new_value END) AS n_{c}" for c in ("label", "station", "org_id", "price")
) + """ FROM g WHERE rn = 1 GROUP BY 1, 2)"""


def _apply(t):
    return cr.apply_changes(t.spark.sql(STORED, place=t.place), "place_id", t.spark.sql(CHANGES, orders=t.orders), "change_id")


@query(
    "m3_apply_changes",
    APPLY_SQL
    + """ SELECT place_id, CASE WHEN c_label = 1 THEN n_label ELSE label END AS label, CASE WHEN c_station = 1 THEN n_station ELSE station END AS station, CASE WHEN c_org_id = 1 THEN TRY_CAST(n_org_id AS BIGINT) ELSE org_id END AS org_id,
          CASE WHEN c_price = 1 THEN TRY_CAST(n_price AS DOUBLE) ELSE price END AS price FROM t LEFT JOIN u ON u.row_id = t.place_id AND u.action = 'update' WHERE place_id NOT IN (SELECT row_id FROM y WHERE problem IS NULL AND action = 'delete')
          UNION ALL SELECT (SELECT max(place_id) FROM t) + row_number() OVER (ORDER BY row_id), n_label, n_station, TRY_CAST(n_org_id AS BIGINT), TRY_CAST(n_price AS DOUBLE) FROM u WHERE action = 'insert'""",
)
def m3(t):
    return _apply(t)[0]


@query("m3_apply_changes_problems", APPLY_SQL + " SELECT row_id, action, field, new_value, problem FROM y WHERE problem IS NOT NULL")
def m3_problems(t):
    return _apply(t)[1]


PROPOSALS = """SELECT person_id AS proposal_id, CASE WHEN balance > 8500 THEN 'nowhere' ELSE 'nation_' || CAST(org_id AS STRING) END AS org_name, CASE WHEN balance BETWEEN 8000 AND 8500 THEN 'Nobody' ELSE person_name END AS person_name,
    '022-' || CAST(person_id AS STRING) AS new_value FROM {person}"""
TWINS = "SELECT person_id, org_id, person_name, office FROM {person} UNION ALL SELECT person_id + 100000000, org_id, person_name, office FROM {person} WHERE balance BETWEEN 100 AND 200"
GUARD_SQL = f"""WITH p AS ({PROPOSALS}), w AS ({TWINS}), h AS (SELECT org_id, lower(person_name) AS k, count(*) AS n, min(person_id) AS person_id, min(office) AS v FROM w GROUP BY 1, 2),
    j AS (SELECT p.*, o.org_id, h.n, h.person_id, CASE WHEN o.org_id IS NULL THEN 'organization not found' WHEN h.n IS NULL THEN 'person not found' WHEN h.n > 1 THEN 'several people'
        WHEN h.person_id IN (SELECT person_id FROM {{person}} WHERE flagged OR status = 'RETIRED') THEN 'excluded' WHEN trim(COALESCE(h.v, '')) <> '' THEN 'not blank' END AS problem
      FROM p LEFT JOIN {{org}} o ON lower(o.org_name) = p.org_name LEFT JOIN h ON h.org_id = o.org_id AND h.k = lower(p.person_name))"""


def _guarded(t):
    excluded = t.person.where("flagged OR status = 'RETIRED'")
    return cr.apply_guarded(t.spark.sql(TWINS, person=t.person), t.spark.sql(PROPOSALS, person=t.person), t.org, "office", excluded)


@query("m4_apply_guarded", GUARD_SQL + " SELECT w.person_id, COALESCE(j.new_value, w.office) AS office FROM w LEFT JOIN j ON j.person_id = w.person_id AND j.problem IS NULL")
def m4(t):
    return _guarded(t)[0].select("person_id", "office")


@query("m4_apply_guarded_problems", GUARD_SQL + " SELECT proposal_id, problem FROM j WHERE problem IS NOT NULL")
def m4_problems(t):
    return _guarded(t)[1]


DECIDE_ROWS = "SELECT doc_id AS row_id, source AS name, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS org FROM {documents}"
DECISIONS = """SELECT CAST(doc_id AS BIGINT) AS decision_id, 'SRC' || CAST(doc_id % 40 AS STRING) AS name, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'fr' ELSE 'de' END AS old_org,
    CASE WHEN quality = 1 AND toxic = 0 THEN 'move' WHEN quality = 0 AND toxic = 1 THEN 'merge' ELSE 'ignore' END AS action, 'hq' AS new_org FROM {labels}"""
DECIDE_SQL = f"""WITH r AS ({DECIDE_ROWS}), d AS (SELECT *, row_number() OVER (PARTITION BY lower(name), old_org ORDER BY decision_id) AS rn FROM ({DECISIONS}) WHERE action <> 'ignore'),
    j AS (SELECT r.*, d.action, d.new_org, min(r.row_id) OVER (PARTITION BY lower(r.name), r.org) AS keep FROM r LEFT JOIN d ON lower(d.name) = lower(r.name) AND d.old_org IS NOT DISTINCT FROM r.org AND d.rn = 1)"""


def _decide(t):
    return cr.apply_decisions(t.spark.sql(DECIDE_ROWS, documents=t.documents), "row_id", "name", "org", t.spark.sql(DECISIONS, labels=t.labels))


@query("m5_apply_decisions", DECIDE_SQL + " SELECT row_id, name, CASE WHEN action = 'move' THEN new_org ELSE org END AS org FROM j WHERE action IS NULL OR action <> 'merge' OR row_id = keep")
def m5(t):
    return _decide(t)[0]


@query("m5_apply_decisions_not_found", DECIDE_SQL + " SELECT decision_id, action FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE lower(r.name) = lower(d.name) AND r.org IS NOT DISTINCT FROM d.old_org)")
def m5_missing(t):
    return _decide(t)[1]


AFTER = "SELECT person_id, CASE WHEN balance < 500 THEN upper(title) ELSE title END AS title, CASE WHEN balance < 100 THEN 'none@x.org' ELSE email END AS email, org_id FROM {person}"


@query(
    "m6_audit_rows",
    f"""WITH j AS (SELECT p.person_id, p.title AS ot, a.title AS nt, p.email AS oe, a.email AS ne FROM {{person}} p JOIN ({AFTER}) a ON a.person_id = p.person_id)
        SELECT 'people' AS table_name, person_id AS row_id, 'title' AS field, ot AS old_value, nt AS new_value, 'review' AS reason FROM j WHERE ot IS DISTINCT FROM nt UNION ALL SELECT 'people', person_id, 'email', oe, ne, 'review' FROM j WHERE oe IS DISTINCT FROM ne""",
)
def m6(t):
    return cr.audit_rows(t.person, t.spark.sql(AFTER, person=t.person), "person_id", ["title", "email", "org_id"], "people", "review")


FIELD_MAP = {"mobile": "mobile", "mobile_no": "mobile", "office": "office", "email": "email", "designation": "title"}
REQ_SQL = """WITH g AS (SELECT request_id, person_id, CASE field_name WHEN 'Mobile No.' THEN 'mobile' WHEN 'email' THEN 'email' WHEN 'Designation' THEN 'title' WHEN 'address' THEN 'address' ELSE 'title' END AS field, COALESCE(new_value, requested_title) AS v FROM {request} WHERE status = 'APPROVED'),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id, field ORDER BY request_id DESC) AS rn FROM g WHERE field <> 'address') WHERE rn = 1)"""


def _requests(t):
    changes = cr.requests_to_changes(t.request, FIELD_MAP, {"requested_title": "title"}, "person_id")
    return cr.apply_changes(t.person.select("person_id", "title", "mobile", "email"), "person_id", changes, "change_id")


@query(
    "m7_apply_requests",
    REQ_SQL + """ SELECT p.person_id, COALESCE(a.v, p.title) AS title, COALESCE(b.v, p.mobile) AS mobile, COALESCE(c.v, p.email) AS email FROM {person} p LEFT JOIN l a ON a.person_id = p.person_id AND a.field = 'title'
       LEFT JOIN l b ON b.person_id = p.person_id AND b.field = 'mobile' LEFT JOIN l c ON c.person_id = p.person_id AND c.field = 'email'""",
)
def m7(t):
    return _requests(t)[0]


@query("m7_apply_requests_problems", REQ_SQL + " SELECT person_id AS row_id, field, v AS new_value, 'unknown field' AS problem FROM g WHERE field = 'address'")
def m7_problems(t):
    return _requests(t)[1].select("row_id", "field", "new_value", "problem")


HEAD_REQ = "SELECT person_id % 100 AS head_id, request_id, field_name, new_value, requested_title, status FROM {request}"


@query(
    "m7_route_linked",
    f"""WITH g AS (SELECT head_id, request_id, CASE field_name WHEN 'Mobile No.' THEN 'mobile' WHEN 'email' THEN 'email' WHEN 'Designation' THEN 'role_title' WHEN 'address' THEN 'address' ELSE 'role_title' END AS field, COALESCE(new_value, requested_title) AS v FROM ({HEAD_REQ}) WHERE status = 'APPROVED')
        SELECT CASE WHEN h.person_id IS NOT NULL AND field IN ('mobile', 'email') THEN 'person' ELSE 'role' END AS target_table, CASE WHEN h.person_id IS NOT NULL AND field IN ('mobile', 'email') THEN h.person_id ELSE g.head_id END AS row_id, request_id AS change_id, 'update' AS action, field, v AS new_value
        FROM g LEFT JOIN {{head}} h ON h.head_id = g.head_id""",
)
def m7_route(t):
    rows = t.spark.sql(HEAD_REQ, request=t.request)
    changes = cr.requests_to_changes(rows, {"mobile_no": "mobile", "email": "email", "designation": "role_title"}, {"requested_title": "role_title"}, "head_id")
    return cr.route_linked(changes, t.head, ["mobile", "email"])


@query("m15_readiness", ENTITY_SQL + ", c AS (SELECT DISTINCT org_id, k FROM i WHERE issue IN ('missing', 'phone')) SELECT count(*) AS n_reviewed, (SELECT count(*) FROM c) AS n_critical, round(100.0 * (count(*) - (SELECT count(*) FROM c)) / count(*), 2)::DOUBLE AS readiness_pct FROM {src_a}")
def m15(t):
    from .bind_reconcile import _entities

    critical = _entities(t).where("issue IN ('missing', 'phone')").select("org_id", "k").distinct()
    return cr.readiness(t.src_a, critical)


RENAMES = "SELECT DISTINCT label AS old_name, 'new ' || label AS new_name FROM {place} WHERE contains(label, 'red') UNION ALL SELECT DISTINCT lower(station), 'x' FROM {place} WHERE org_id = 3"
DELETES = "SELECT DISTINCT label AS old_name FROM {place} WHERE contains(label, 'hot') UNION ALL SELECT DISTINCT 'gone ' || station FROM {place} WHERE org_id = 4"
MOVES = "SELECT DISTINCT label AS old_name, CAST(5 AS BIGINT) AS new_org FROM {place} WHERE contains(label, 'ring') UNION ALL SELECT DISTINCT 'lost ' || station, CAST(6 AS BIGINT) FROM {place} WHERE org_id = 5"


def _curated(t):
    rows = t.place.select("place_id", "label", "org_id")
    q = lambda s: t.spark.sql(s, place=t.place)
    return cr.apply_curated(rows, "place_id", "label", "org_id", q(RENAMES), q(DELETES), q(MOVES))


@query(
    "m16_apply_curated",
    """SELECT place_id, CASE WHEN contains(label, 'red') THEN 'new ' || label ELSE label END AS label, CASE WHEN contains(label, 'ring') THEN 5 ELSE org_id END AS org_id FROM {place} WHERE NOT contains(label, 'hot')""",
)
def m16(t):
    return _curated(t)[0]


@query(
    "m16_apply_curated_report",
    f"""WITH n AS (SELECT DISTINCT label FROM {{place}}) SELECT DISTINCT 'rename' AS fix, old_name FROM ({RENAMES}) WHERE old_name NOT IN (SELECT label FROM n) UNION ALL SELECT DISTINCT 'delete', old_name FROM ({DELETES}) WHERE old_name NOT IN (SELECT label FROM n)
        UNION ALL SELECT DISTINCT 'reassign', old_name FROM ({MOVES}) WHERE old_name NOT IN (SELECT label FROM n)""",
)
def m16_report(t):
    return _curated(t)[1]


@query(
    "m17_conservation",
    """SELECT count(*) AS n_whole, count_if(category IS NOT NULL) + count_if(category IS NULL AND price > 905) AS n_parts, count_if(category IS NULL AND price <= 905) AS n_lost, CAST(0 AS BIGINT) AS n_added, count_if(category IS NULL AND price <= 905) = 0 AS is_conserved FROM {place}""",
)
def m17(t):
    parts = [t.place.where("category IS NOT NULL"), t.place.where("category IS NULL AND price > 905")]
    return cr.conservation(t.place, parts, ["place_id", "label", "category"])


INCOMING = """SELECT person_id + 50000000 AS person_id, CASE WHEN balance BETWEEN 300 AND 350 THEN ' ' WHEN balance > 6000 THEN 'New ' || person_name WHEN balance BETWEEN 5000 AND 5200 THEN 'Twin' ELSE person_name END AS person_name,
    CASE WHEN balance < -700 THEN 900 ELSE org_id END AS org_id, email, CASE WHEN balance > 9500 THEN '12345' ELSE mobile END AS mobile FROM {person}"""


@query(
    "m18_validate_rows",
    f"""WITH r AS (SELECT *, lower(trim(person_name)) AS k, row_number() OVER (PARTITION BY lower(trim(person_name)), org_id ORDER BY person_id) AS rn FROM ({INCOMING})), d AS (SELECT *, regexp_replace(COALESCE(mobile, ''), '[^0-9]+', '', 'g') AS dg FROM r)
        SELECT person_id, 'blank name' AS problem FROM d WHERE k = '' UNION ALL SELECT person_id, 'bad email' FROM d WHERE trim(COALESCE(email, '')) <> '' AND NOT regexp_matches(trim(email), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')
        UNION ALL SELECT person_id, 'bad phone' FROM d WHERE trim(COALESCE(mobile, '')) <> '' AND NOT ((length(dg) = 12 AND starts_with(dg, '91')) OR (length(dg) = 11 AND starts_with(dg, '0')) OR length(dg) = 10)
        UNION ALL SELECT person_id, 'unknown organization' FROM d WHERE org_id NOT IN (SELECT org_id FROM {{org}}) UNION ALL SELECT person_id, 'already stored' FROM d WHERE EXISTS (SELECT 1 FROM {{person}} p WHERE lower(p.person_name) = d.k AND p.org_id = d.org_id)
        UNION ALL SELECT person_id, 'repeated' FROM d WHERE rn > 1""",
)
def m18(t):
    return cr.validate_rows(t.spark.sql(INCOMING, person=t.person), t.person, "person_id", "person_name", "org_id", t.org)
