"""Bindings: duplicates and merges."""

from pyspark.sql import functions as F

from rosterloom.functions.rules import Rule
from rosterloom.operators import dedupe as dd

from .tables import query

EV = ["label", "station", "category", "org_id"]


@query("f1_dup_keys", "SELECT label, station, count(*) AS n_rows FROM {place} GROUP BY 1, 2 HAVING count(*) > 1")
def f1(t):
    return dd.dup_keys(t.place, ["label", "station"])


@query("f1_dup_keys_lines", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def f1_lines(t):
    return dd.dup_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


DUP_ROWS = """SELECT place_id, label, station, category, min(place_id) OVER w AS keep_id, count(*) OVER w AS n_rows,
    CASE WHEN place_id = min(place_id) OVER w THEN max(place_id) OVER w ELSE min(place_id) OVER w END AS sibling_id FROM {place} WINDOW w AS (PARTITION BY label, category)"""


@query("f2_dup_rows", f"SELECT * FROM ({DUP_ROWS}) WHERE n_rows > 1")
def f2(t):
    return dd.dup_rows(t.place.select("place_id", "label", "station", "category"), ["label", "category"], "place_id")


EXACT = "SELECT place_id, label, category, org_id, min(place_id) OVER (PARTITION BY label, category, org_id) AS keep_id FROM {place}"


@query("f3_exact_dups", f"SELECT * FROM ({EXACT}) WHERE place_id > keep_id")
def f3(t):
    return dd.exact_dups(t.place, ["label", "category", "org_id"], "place_id")


@query(
    "f4_near_dups",
    f"""WITH s AS (SELECT * FROM ({EXACT}) WHERE place_id = keep_id)
        SELECT place_id, label, org_id, category, n AS n_rows FROM (SELECT *, count(*) OVER (PARTITION BY label, org_id) AS n FROM s) WHERE n > 1""",
)
def f4(t):
    gone = dd.exact_dups(t.place, ["label", "category", "org_id"], "place_id")
    rows = t.place.select("place_id", "label", "org_id", "category")
    return dd.near_dups(rows, gone, ["label", "org_id"], "place_id").select("place_id", "label", "org_id", "category", "n_rows")


ORPHANS = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' OR o_totalprice > 250000 THEN NULL ELSE o_orderkey END AS ref FROM {orders}"


@query(
    "f5_orphan_dups",
    f"""WITH x AS ({ORPHANS}), n AS (SELECT o_custkey, count(ref) AS n_valid, count_if(ref IS NULL) AS n_orphan FROM x GROUP BY 1)
        SELECT o_orderkey, x.o_custkey, n_valid, n_orphan, CASE WHEN n_valid = 1 AND n_orphan = 1 THEN 'drop orphan' WHEN n_valid = 0 THEN 'review: no valid row'
          WHEN n_valid > 1 THEN 'review: several valid rows' ELSE 'review: several orphans' END AS action FROM x JOIN n ON n.o_custkey = x.o_custkey WHERE ref IS NULL AND n_valid + n_orphan > 1""",
)
def f5(t):
    return dd.orphan_dups(t.spark.sql(ORPHANS, orders=t.orders), "o_custkey", "ref", "o_orderkey")


EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"


@query(
    "f6_shared_values",
    f"""WITH h AS (SELECT DISTINCT doc_id, unnest(list_concat(regexp_extract_all(text, '[0-9]{{8,}}'), regexp_extract_all(lower(text), '{EMAIL}'))) AS value FROM documents
          UNION SELECT DISTINCT 1000000 + person_id, unnest(regexp_extract_all(lower(COALESCE(email, '')), '{EMAIL}')) FROM {{person}})
        SELECT h.doc_id AS owner, h.value, n AS n_owners FROM h JOIN (SELECT value, count(*) AS n FROM h GROUP BY 1 HAVING count(*) > 1) s ON s.value = h.value""",
)
def f6(t):
    people = t.person.selectExpr("1000000 + person_id", "CAST(NULL AS STRING)", "email")
    held = t.documents.selectExpr("doc_id AS owner", "text", "CAST(NULL AS STRING) AS email").union(people)
    return dd.shared_values(held, "owner", "text", email="email")


MERGES = "SELECT org_id AS loser, org_id - 5 AS winner FROM {org} WHERE org_id BETWEEN 15 AND 30 OR org_id = 2 OR org_id = 11"
PARENTS = "SELECT org_id, org_name, CASE WHEN org_id BETWEEN 10 AND 17 THEN '' ELSE state END AS state FROM {org}"
MERGE_CTE = f"""WITH m AS ({MERGES}), p AS ({PARENTS}), u AS (SELECT * FROM m WHERE winner IN (SELECT org_id FROM p) AND winner NOT IN (SELECT loser FROM m))"""


@query(
    "f7_apply_merge_parents",
    MERGE_CTE
    + """ SELECT p.org_id, p.org_name, CASE WHEN trim(p.state) = '' THEN COALESCE((SELECT min_by(l.state, l.org_id) FROM p l JOIN u ON u.loser = l.org_id WHERE u.winner = p.org_id AND trim(l.state) <> ''), p.state) ELSE p.state END AS state,
          p.org_id IN (SELECT loser FROM m) AS refused FROM p WHERE p.org_id NOT IN (SELECT loser FROM u)""",
)
def f7_parents(t):
    parents, _ = dd.apply_merge(t.spark.sql(PARENTS, org=t.org), t.person, t.spark.sql(MERGES, org=t.org), "org_id", ["state"])
    return parents


@query(
    "f7_apply_merge_children",
    MERGE_CTE + " SELECT c.person_id, COALESCE(u.winner, c.org_id) AS org_id FROM {person} c LEFT JOIN u ON u.loser = c.org_id",
)
def f7_children(t):
    _, children = dd.apply_merge(t.spark.sql(PARENTS, org=t.org), t.person, t.spark.sql(MERGES, org=t.org), "org_id", ["state"])
    return children.select("person_id", "org_id")


@query(
    "f8_dup_span",
    "SELECT label, station, count(*) AS n_rows, min(place_id) AS keep_id, max(place_id) AS last_id, count(*) - 1 AS n_dropped FROM {place} GROUP BY 1, 2 HAVING count(*) > 1",
)
def f8(t):
    return dd.dup_span(t.place, ["label", "station"], "place_id")


FILL_A = """SELECT person_id, CASE WHEN person_id % 17 <> 0 THEN org_id END AS org_id, CASE WHEN balance < 2000 THEN person_name WHEN balance < 5000 THEN replace(person_name, 'tomer', 'tmoer') ELSE 'Mr. ' || person_name END AS person_name,
    CASE WHEN balance > 7000 THEN 'Director' ELSE title END AS title, CASE WHEN dept = 'BUILDING' THEN NULL ELSE mobile END AS mobile, '' AS office FROM {person}"""
FILL_B = """SELECT person_id + 1000000 AS dup_id, CASE WHEN person_id % 17 <> 0 THEN org_id END AS org_id, person_name, title, mobile, office FROM {person}
    UNION ALL SELECT person_id + 2000000, CASE WHEN person_id % 17 <> 0 THEN org_id END, person_name, title, mobile, office FROM {person} WHERE balance BETWEEN 1000 AND 1500"""
PKEY = "trim(regexp_replace(regexp_replace(replace(lower(person_name), '&', ' and '), '\\b(shri|smt|mr|mrs|ms|dr)\\b\\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "f9_backfill",
    f"""WITH a AS (SELECT *, {PKEY} AS k FROM ({FILL_A})), b AS (SELECT *, {PKEY} AS k FROM ({FILL_B})),
         d AS (SELECT org_id, k, min(dup_id) AS donor_id, count(*) AS n, min(lower(title)) AS lo, max(lower(title)) AS hi FROM b GROUP BY 1, 2),
         ex AS (SELECT a.*, d.donor_id, n, lo, hi, TRUE AS is_exact FROM a JOIN d ON d.org_id IS NOT DISTINCT FROM a.org_id AND d.k = a.k),
         cand AS (SELECT a.*, d.donor_id, n, lo, hi, row_number() OVER (PARTITION BY a.person_id ORDER BY 1 - levenshtein(a.k, d.k) / greatest(length(a.k), length(d.k)) DESC, d.k) AS rn
            FROM a JOIN d ON d.org_id IS NOT DISTINCT FROM a.org_id WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.org_id IS NOT DISTINCT FROM a.org_id AND e.k = a.k) AND 1 - levenshtein(a.k, d.k) / greatest(length(a.k), length(d.k)) >= 0.82),
         x AS (SELECT person_id, org_id, title, mobile, office, donor_id, n, lo, hi, is_exact FROM ex UNION ALL SELECT person_id, org_id, title, mobile, office, donor_id, n, lo, hi, FALSE FROM cand WHERE rn = 1),
         y AS (SELECT x.*, CASE WHEN is_exact AND n = 1 AND lo = lower(x.title) AND hi = lower(x.title) THEN 'HIGH' ELSE 'NEEDS_REVIEW' END AS confidence, b.mobile AS bm, b.office AS bo FROM x JOIN b ON b.dup_id = x.donor_id)
        SELECT person_id, org_id, donor_id, confidence, is_exact, 'mobile' AS field, bm AS proposed_value FROM y WHERE trim(COALESCE(mobile, '')) = '' AND trim(COALESCE(bm, '')) <> ''
        UNION ALL SELECT person_id, org_id, donor_id, confidence, is_exact, 'office', bo FROM y WHERE trim(COALESCE(office, '')) = '' AND trim(COALESCE(bo, '')) <> ''""",
)
def f9(t):
    a, b = t.spark.sql(FILL_A, person=t.person), t.spark.sql(FILL_B, person=t.person)
    return dd.backfill(a, b, "org_id", "person_name", "title", ["mobile", "office"], "person_id", "dup_id")


SHORT_A = """SELECT person_id, CASE WHEN person_id % 17 <> 0 THEN org_id END AS org_id, CASE WHEN person_id % 5 = 0 THEN 'Mr. ' || substr(person_name, 10, 9) WHEN person_id % 3 = 0 THEN 'Dr. ' || right(person_name, 2) ELSE person_name END AS person_name,
    CASE WHEN dept = 'BUILDING' THEN NULL ELSE mobile END AS mobile FROM {person}"""
SHORT_B = """SELECT person_id AS dup_id, CASE WHEN person_id % 17 <> 0 THEN org_id END AS org_id, right(person_name, 2) AS person_name FROM {person} WHERE person_id % 2 = 0"""


@query(
    "f9_short_names",
    f"""WITH a AS (SELECT *, {PKEY} AS k FROM ({SHORT_A})), b AS (SELECT org_id, {PKEY} AS k FROM ({SHORT_B}))
        SELECT person_id, org_id, person_name, 'too short' AS status FROM a WHERE trim(COALESCE(mobile, '')) = '' AND length(k) BETWEEN 1 AND 3
          AND NOT EXISTS (SELECT 1 FROM b WHERE b.org_id IS NOT DISTINCT FROM a.org_id AND b.k = a.k)""",
)
def f9_short(t):
    a, b = t.spark.sql(SHORT_A, person=t.person), t.spark.sql(SHORT_B, person=t.person)
    return dd.short_names(a, b, "org_id", "person_name", ["mobile"], "person_id")


SIGNALS = [
    Rule("Control desk", "email", contains=("@economy", "@medium")),
    Rule("Yard desk", "email", contains=("@promo", "@large")),
    Rule("Hotline desk", "email", contains=("hot.",)),
]


@query(
    "f10_relabel_by_signal",
    """SELECT place_id, label, label AS current_label, p AS proposed_label, CASE WHEN p IS NULL THEN 'needs review' ELSE 'rename' END AS action FROM (
         SELECT *, CASE WHEN contains(email, '@economy') OR contains(email, '@medium') THEN 'Control desk' WHEN contains(email, '@promo') OR contains(email, '@large') THEN 'Yard desk' WHEN contains(email, 'hot.') THEN 'Hotline desk' END AS p
         FROM {place}) WHERE label IN (SELECT label FROM {place} GROUP BY 1 HAVING count(*) > 1)""",
)
def f10(t):
    places = t.place.withColumn("current", F.col("label"))
    return dd.relabel_by_signal(places, "label", "place_id", "current", SIGNALS)
