"""Bindings: data quality."""

from pyspark.sql import functions as F

from rosterloom.operators import quality as ql

from .tables import query


def _cov(col, label):
    return f"""SELECT count(*) AS n_rows, '{label}' AS field, count_if({col}) AS n_blank, round(100.0 * (count(*) - count_if({col})) / count(*), 2)::DOUBLE AS coverage_pct FROM {{person}}"""


def _blank(c):
    return f"trim(COALESCE({c}, '')) = ''"


@query(
    "g1_completeness",
    " UNION ALL ".join([_cov(_blank(c), c) for c in ("mobile", "office", "email")] + [_cov(" AND ".join(_blank(c) for c in ("mobile", "office", "email")), "(all)")]),
)
def g1(t):
    return ql.completeness(t.person, ["mobile", "office", "email"]).withColumn("coverage_pct", F.col("coverage_pct").cast("double"))


@query(
    "g2_childless",
    """SELECT o.org_id, o.org_name, count(p.person_id) AS n_children, count(CASE WHEN p.flagged THEN 1 END) AS n_flagged, CASE WHEN count(p.person_id) = 0 THEN 'no children' ELSE 'no flagged child' END AS issue
       FROM {org} o LEFT JOIN (SELECT * FROM {person} WHERE dept = 'BUILDING' AND (org_id < 12 OR org_id > 14)) p ON p.org_id = o.org_id GROUP BY 1, 2 HAVING count(CASE WHEN p.flagged THEN 1 END) = 0""",
)
def g2(t):
    people = t.person.where("dept = 'BUILDING' AND (org_id < 12 OR org_id > 14)")
    out = ql.childless(t.org.select("org_id", "org_name"), people, "org_id", F.col("flagged"))
    return out.select("org_id", "org_name", "n_children", "n_flagged", "issue")


FLAGGY = """SELECT doc_id, CASE WHEN lang = 'en' AND source < 'src12' THEN replace(text, ', ', ',  ') WHEN lang = 'de' THEN text || ' ' WHEN source = 'src3' THEN '–' || text WHEN source = 'src5' THEN 'N/A' ELSE replace(text, 'the', 'sector ') END AS text FROM {documents}"""


@query(
    "g3_text_flags",
    f"""SELECT * FROM (SELECT doc_id, concat_ws(', ', CASE WHEN contains(text, '  ') THEN 'double space' END, CASE WHEN text <> trim(text) THEN 'edge space' END, CASE WHEN regexp_matches(text, '[\\x{{200B}}\\x{{FFFD}}]') THEN 'garbage character' END,
          CASE WHEN regexp_matches(text, '[\\x{{2013}}\\x{{2014}}]') THEN 'unicode dash' END, CASE WHEN contains(lower(text), 'road no') OR contains(lower(text), 'plot no') OR contains(lower(text), 'sector ') OR contains(lower(text), 'flat ') OR contains(lower(text), 'survey') THEN 'address words' END,
          CASE WHEN lower(text) IN ('', '-', '--', 'na', 'n/a', 'n a', 'nil', 'none') THEN 'placeholder' END) AS flags FROM ({FLAGGY})) WHERE flags <> ''""",
)
def g3(t):
    return ql.text_flags(t.spark.sql(FLAGGY, documents=t.documents), "doc_id", "text")


ADDR = """SELECT place_id, CASE WHEN org_id < 3 THEN raw_label || ' Address: Main Road, Block 2, City - 492013' WHEN org_id < 6 THEN raw_label || ' (near the old mill gate)' WHEN org_id < 8 THEN raw_label || ' Northtown' WHEN org_id < 9 THEN raw_label || ' Load Despatch Centre Backup'
    WHEN org_id < 11 THEN raw_label || repeat(' line', 20) ELSE raw_label END AS label FROM {place}"""


@query(
    "g4_address_signals",
    f"""SELECT place_id, signals, len(string_split(signals, '; ')) AS n_signals, CASE WHEN signals = 'place name' THEN 'low' ELSE 'high' END AS tier, CASE WHEN contains(label, 'Address:') THEN trim(split_part(label, 'Address:', 1)) END AS proposed_label FROM (
         SELECT place_id, label, concat_ws('; ', CASE WHEN contains(lower(label), 'address:') THEN 'marker' END, CASE WHEN regexp_matches(label, '-\\s*[0-9]{{6}}\\b') THEN 'postal code' END, CASE WHEN regexp_matches(label, '\\([^()]{{10,}}\\)') THEN 'long parenthesis' END,
           CASE WHEN length(label) - length(replace(label, ',', '')) >= 2 THEN 'commas' END, CASE WHEN contains(lower(label), 'backup') THEN 'backup' END, CASE WHEN contains(lower(label), 'load despatch centre') THEN 'organization text' END,
           CASE WHEN contains(lower(label), 'northtown') OR contains(lower(label), 'red') THEN 'place name' END, CASE WHEN length(label) > 80 THEN 'long' END) AS signals FROM ({ADDR})) WHERE signals <> ''""",
)
def g4(t):
    return ql.address_signals(t.spark.sql(ADDR, place=t.place), "place_id", "label", ["load despatch centre"], ["northtown", "red"])


@query(
    "g5_repeated_segments",
    """WITH s AS (SELECT place_id, phone, trim(unnest(regexp_split_to_array(phone, '[/;,]'))) AS seg FROM {place}), c AS (SELECT place_id, phone, seg, count(*) AS n FROM s WHERE seg <> '' GROUP BY ALL)
       SELECT place_id, phone AS raw_value, max(n) AS max_repeat FROM c GROUP BY 1, 2 HAVING max(n) >= 2""",
)
def g5(t):
    return ql.repeated_segments(t.place, "place_id", "phone")


@query("g6_no_digit", "SELECT doc_id, text AS raw_value FROM documents WHERE trim(text) <> '' AND NOT regexp_matches(text, '[0-9]')")
def g6(t):
    return ql.no_digit(t.documents, "doc_id", "text")


@query(
    "g7_numbered_prefix",
    r"""WITH r AS (SELECT place_id, station, raw_label, lower(trim(raw_label)) AS f, lower(trim(regexp_replace(raw_label, '^[0-9]+(\.[0-9]+)*\.?\s*', ''))) AS b FROM {place} WHERE trim(regexp_replace(raw_label, '^[0-9]+(\.[0-9]+)*\.?\s*', '')) <> trim(raw_label)),
            l AS (SELECT DISTINCT station, lower(CASE WHEN org_id < 4 THEN raw_label ELSE label END) AS l FROM {place} WHERE station <> 'Brand#3' AND category IS NOT NULL),
            s AS (SELECT r.*, CASE WHEN NOT EXISTS (SELECT 1 FROM l WHERE l.station = r.station) THEN 'no data' WHEN EXISTS (SELECT 1 FROM l WHERE l.station = r.station AND l.l = r.f) THEN 'same in source'
                  WHEN EXISTS (SELECT 1 FROM l WHERE l.station = r.station AND l.l = r.b) THEN 'confirmed' ELSE 'unconfirmed' END AS status FROM r)
       SELECT place_id, station, raw_label, status FROM s WHERE status <> 'same in source'""",
)
def g7(t):
    labels = t.place.where("station <> 'Brand#3' AND category IS NOT NULL").selectExpr("station", "CASE WHEN org_id < 4 THEN raw_label ELSE label END AS l")
    return ql.numbered_prefix(t.place, "place_id", "station", "raw_label", labels, "l")


BROKEN = """SELECT CASE WHEN balance BETWEEN 100 AND 150 THEN NULL WHEN balance BETWEEN 200 AND 250 THEN 7 ELSE person_id END AS person_id, CASE WHEN balance BETWEEN 300 AND 330 THEN ' ' ELSE person_name END AS person_name,
    CASE WHEN balance BETWEEN 400 AND 450 THEN 777 ELSE org_id END AS org_id FROM {person}"""
INTEGRITY_SQL = f"""WITH p AS ({BROKEN}), o AS (SELECT * FROM {{org}}) SELECT 'missing id' AS check_name, 'people' AS table_name, CAST(NULL AS VARCHAR) AS row_ref, person_name AS message FROM p WHERE person_id IS NULL
    UNION ALL SELECT 'blank name', 'people', CAST(person_id AS VARCHAR), 'name is blank' FROM p WHERE trim(person_name) = ''
    UNION ALL SELECT 'duplicate id', 'people', CAST(person_id AS VARCHAR), CAST(count(*) AS VARCHAR) || ' rows' FROM p WHERE person_id IS NOT NULL GROUP BY person_id HAVING count(*) > 1
    UNION ALL SELECT 'unknown parent', 'people', CAST(person_id AS VARCHAR), 'org_id=' || CAST(org_id AS VARCHAR) FROM p WHERE org_id NOT IN (SELECT org_id FROM o)
    UNION ALL SELECT 'unknown parent', 'requests', CAST(request_id AS VARCHAR), 'person_id=' || CAST(person_id AS VARCHAR) FROM {{request}} r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.person_id = r.person_id)
    UNION ALL SELECT 'blank name', 'requests', CAST(request_id AS VARCHAR), 'name is blank' FROM {{request}} WHERE trim(COALESCE(field_name, '')) = ''"""


def _integrity(t):
    people = t.spark.sql(BROKEN, person=t.person)
    tables = {"people": (people, "person_id", "person_name"), "orgs": (t.org, "org_id", "org_name"), "requests": (t.request, "request_id", "field_name")}
    fks = [ql.ForeignKey("people", "org_id", "orgs", "org_id"), ql.ForeignKey("orgs", "parent_id", "orgs", "org_id"), ql.ForeignKey("requests", "person_id", "people", "person_id")]
    return ql.integrity(tables, fks)


@query("g8_integrity", INTEGRITY_SQL)
def g8(t):
    return _integrity(t)


CHILDREN = "SELECT person_id, CASE WHEN balance < -500 THEN 333 WHEN balance < 0 THEN NULL ELSE org_id END AS child_id, CASE WHEN balance > 9000 THEN 1000 ELSE 1000 + org_id % 5 END AS parent FROM {person}"


@query(
    "g9_hierarchy_check",
    f"""SELECT c.person_id, c.child_id, CAST(c.parent AS BIGINT) AS parent, o.parent_id AS real_parent, CASE WHEN o.org_id IS NULL THEN 'unknown child' ELSE 'wrong parent' END AS issue FROM ({CHILDREN}) c LEFT JOIN {{org}} o ON o.org_id = c.child_id
        WHERE c.child_id IS NOT NULL AND (o.org_id IS NULL OR o.parent_id IS DISTINCT FROM c.parent)""",
)
def g9(t):
    rows = t.spark.sql(CHILDREN, person=t.person).withColumn("parent", F.col("parent").cast("bigint"))
    return ql.hierarchy_check(rows, "person_id", "child_id", "parent", t.org)


SEV = {"missing id": "ERROR", "duplicate id": "ERROR", "unknown parent": "ERROR"}
SEV_SQL = "CASE WHEN check_name IN ('missing id', 'duplicate id', 'unknown parent') THEN 'ERROR' ELSE 'WARNING' END"


@query("g10_gate_counts", f"WITH i AS ({INTEGRITY_SQL}) SELECT check_name, count(*) AS n_issues, {SEV_SQL} AS severity, greatest(count(*) - 50, 0) AS n_hidden FROM i GROUP BY 1")
def g10_counts(t):
    return ql.gate(_integrity(t), SEV, keep=50)[0]


@query(
    "g10_gate_messages",
    f"""WITH i AS ({INTEGRITY_SQL}) SELECT check_name, table_name, row_ref, message, rank FROM (SELECT *, row_number() OVER (PARTITION BY check_name ORDER BY table_name, row_ref NULLS FIRST, message) AS rank FROM i) WHERE rank <= 50""",
)
def g10_messages(t):
    return ql.gate(_integrity(t), SEV, keep=50)[1].withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "g10_gate_verdict",
    f"""WITH i AS ({INTEGRITY_SQL}), c AS (SELECT {SEV_SQL} AS s FROM i) SELECT count_if(s = 'ERROR') AS n_errors, count_if(s = 'WARNING') AS n_warnings, count_if(s = 'ERROR') = 0 AS passed FROM c""",
)
def g10_verdict(t):
    return ql.gate(_integrity(t), SEV, keep=50)[2]


MEMBERS = "SELECT org_id % 7 AS list_id, CASE WHEN balance BETWEEN 9000 AND 9050 THEN person_id + 9000000 ELSE person_id END AS person_id FROM {person} UNION ALL SELECT org_id % 7, person_id FROM {person} WHERE balance < -800"
RULES = """SELECT CAST(o_orderkey AS BIGINT) AS rule_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'ORGANIZATION' WHEN '2-HIGH' THEN 'STATUS' WHEN '3-MEDIUM' THEN 'ROLE' WHEN '4-NOT SPECIFIED' THEN 'ORGANIZATION_SUBCATEGORY' ELSE 'COLOUR' END AS filter_type,
    CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END AS org_id, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_totalprice < 9000 THEN 'x' END AS category, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'y' END AS subcategory,
    CASE WHEN o_orderpriority = '3-MEDIUM' AND o_totalprice > 20000 THEN 'KMP' END AS role, CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderstatus WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 400000 THEN 'P' END AS status, CAST(NULL AS BIGINT) AS person_id FROM {orders}"""
OKMAIL = r"regexp_matches(trim(%s), '^[^@\s]+@[^@\s]+\.[^@\s]+$')"


@query(
    "g11_audit_lists",
    f"""WITH m AS ({MEMBERS}), r AS ({RULES}) SELECT 'duplicate member' AS check_name, 'members' AS table_name, CAST(list_id AS VARCHAR) || '/' || CAST(person_id AS VARCHAR) AS row_ref, CAST(count(*) AS VARCHAR) || ' times' AS message FROM m GROUP BY list_id, person_id HAVING count(*) > 1
        UNION ALL SELECT 'broken reference', 'members', CAST(list_id AS VARCHAR) || '/' || CAST(person_id AS VARCHAR), 'no such person' FROM m WHERE person_id NOT IN (SELECT person_id FROM {{person}})
        UNION ALL SELECT 'bad email', 'members', CAST(list_id AS VARCHAR) || '/' || CAST(m.person_id AS VARCHAR), p.email FROM m JOIN {{person}} p ON p.person_id = m.person_id WHERE trim(COALESCE(p.email, '')) <> '' AND NOT {OKMAIL % 'p.email'}
        UNION ALL SELECT 'malformed rule', 'rules', CAST(rule_id AS VARCHAR), filter_type FROM r WHERE (CAST(org_id IS NOT NULL AS INT) + CAST(category IS NOT NULL AS INT) + CAST(subcategory IS NOT NULL AS INT) + CAST(role IS NOT NULL AS INT) + CAST(status IS NOT NULL AS INT) + CAST(person_id IS NOT NULL AS INT)) <> 1
          OR NOT CASE filter_type WHEN 'ORGANIZATION' THEN org_id IS NOT NULL WHEN 'STATUS' THEN status IS NOT NULL WHEN 'ROLE' THEN role IS NOT NULL WHEN 'ORGANIZATION_SUBCATEGORY' THEN subcategory IS NOT NULL ELSE FALSE END""",
)
def g11_lists(t):
    return ql.audit_lists(t.spark.sql(MEMBERS, person=t.person), t.spark.sql(RULES, orders=t.orders), t.person)


HEADS = """SELECT head_id, org_id, role_title, CASE WHEN head_id > 90 THEN 5000000 + head_id ELSE person_id END AS person_id, name, CASE WHEN org_id = 4 THEN 'not an address' WHEN org_id = 7 THEN NULL ELSE email END AS email FROM {head}
    UNION ALL SELECT 200 + person_id, org_id, 'Seat ' || CAST(person_id AS STRING), person_id, NULL, NULL FROM {person} WHERE balance < 600"""


@query(
    "g11_audit_roles",
    f"""WITH h AS ({HEADS}) SELECT 'possible duplicate' AS check_name, 'heads' AS table_name, CAST(org_id AS VARCHAR) || '/' || role_title AS row_ref, CAST(count(*) AS VARCHAR) || ' rows' AS message FROM h GROUP BY org_id, role_title HAVING count(*) > 1
        UNION ALL SELECT 'broken reference', 'heads', CAST(head_id AS VARCHAR), 'no such person' FROM h WHERE person_id IS NOT NULL AND person_id NOT IN (SELECT person_id FROM {{person}})
        UNION ALL SELECT 'bad email', 'heads', CAST(head_id AS VARCHAR), p.email FROM h JOIN {{person}} p ON p.person_id = h.person_id WHERE trim(COALESCE(p.email, '')) <> '' AND NOT {OKMAIL % 'p.email'}
        UNION ALL SELECT 'missing email', 'heads', CAST(head_id AS VARCHAR), 'linked person has no email' FROM h JOIN {{person}} p ON p.person_id = h.person_id WHERE trim(COALESCE(p.email, '')) = ''
        UNION ALL SELECT 'bad email', 'heads', CAST(head_id AS VARCHAR), email FROM h WHERE person_id IS NULL AND trim(COALESCE(email, '')) <> '' AND NOT {OKMAIL % 'email'}
        UNION ALL SELECT 'missing identity', 'heads', CAST(head_id AS VARCHAR), 'no name or email' FROM h WHERE person_id IS NULL AND trim(COALESCE(name, '')) = '' AND trim(COALESCE(email, '')) = ''""",
)
def g11_roles(t):
    return ql.audit_roles(t.spark.sql(HEADS, head=t.head, person=t.person), t.person)


INVARIANTS = [
    ql.Unique(["request_id"]),
    ql.Unique(["person_id", "field_name"], "status = 'PENDING'"),
    ql.Domain("status", ["APPROVED", "PENDING"]),
    ql.OneOf(["field_name", "requested_note"]),
]


@query(
    "g12_check_invariants",
    """WITH r AS (SELECT *, CASE WHEN status = 'APPROVED' THEN requested_title END AS requested_note FROM {request}) SELECT 'unique(person_id, field_name) where status = ''PENDING''' AS rule, concat_ws('/', CAST(person_id AS VARCHAR), field_name) AS row_ref, count(*) AS n FROM r WHERE status = 'PENDING' AND person_id IS NOT NULL AND field_name IS NOT NULL GROUP BY person_id, field_name HAVING count(*) > 1
       UNION ALL SELECT 'unique(request_id)', CAST(request_id AS VARCHAR), count(*) FROM r GROUP BY request_id HAVING count(*) > 1 UNION ALL SELECT 'domain(status)', CAST(request_id AS VARCHAR), 1 FROM r WHERE status NOT IN ('APPROVED', 'PENDING')
       UNION ALL SELECT 'one of(field_name, requested_note)', CAST(request_id AS VARCHAR), 1 FROM r WHERE field_name IS NULL AND requested_note IS NULL""",
)
def g12(t):
    rows = t.request.withColumn("requested_note", F.expr("CASE WHEN status = 'APPROVED' THEN requested_title END"))
    return ql.check_invariants(rows, "request_id", INVARIANTS)


ISSUES = """SELECT person_id, 'no mobile' AS issue FROM {person} WHERE mobile IS NULL OR trim(mobile) = '' UNION ALL SELECT person_id, 'no email' FROM {person} WHERE email IS NULL OR trim(email) = ''
    UNION ALL SELECT person_id, 'not active' FROM {person} WHERE status <> 'ACTIVE' UNION ALL SELECT person_id, 'not active' FROM {request} WHERE status = 'REJECTED'"""


@query("g13_issue_profile_types", f"SELECT issue, count(DISTINCT person_id) AS n_rows FROM ({ISSUES}) GROUP BY 1")
def g13_types(t):
    return ql.issue_profile(t.spark.sql(ISSUES, person=t.person, request=t.request), "person_id", "issue")[0]


@query("g13_issue_profile_rows", f"SELECT n_types, count(*) AS n_rows FROM (SELECT person_id, count(DISTINCT issue) AS n_types FROM ({ISSUES}) GROUP BY 1) GROUP BY 1")
def g13_rows(t):
    return ql.issue_profile(t.spark.sql(ISSUES, person=t.person, request=t.request), "person_id", "issue")[1]
