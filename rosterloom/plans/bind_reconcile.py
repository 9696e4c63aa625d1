"""Bindings: reconciliation."""

from pyspark.sql import functions as F

from rosterloom.functions import text as tx
from rosterloom.functions.rules import Rule
from rosterloom.operators import reconcile as rc

from .tables import RATIOS_SQL, query

EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"
FOLD = "lower(trim(regexp_replace(COALESCE(%s, ''), '\\s+', ' ', 'g')))"


@query(
    "e1_presence_diff",
    """WITH a AS (SELECT o_custkey AS grp, o_orderkey AS k, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2),
            b AS (SELECT o_custkey AS grp, l_orderkey AS k, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
            j AS (SELECT COALESCE(a.grp, b.grp) AS grp, COALESCE(a.k, b.k) AS k, COALESCE(a.n, 0) AS n_a, COALESCE(b.n, 0) AS n_b FROM a FULL JOIN b ON a.grp = b.grp AND a.k = b.k)
       SELECT *, 'Missing' AS issue FROM j WHERE n_b = 0 UNION ALL SELECT *, 'Extra' FROM j WHERE n_a = 0 UNION ALL SELECT *, 'Duplicate' FROM j WHERE n_b > 1""",
)
def e1(t):
    a = t.orders.where("o_orderpriority <> '5-LOW'").selectExpr("o_custkey AS grp", "o_orderkey AS k")
    lines = t.lineitem.selectExpr("l_orderkey AS k")
    b = lines.join(t.orders.selectExpr("o_custkey AS grp", "o_orderkey AS k"), "k")
    return rc.presence_diff(a, b, "grp", "k")


SETS_SQL = f"""WITH a AS (SELECT {FOLD % 'person_name'} AS k, mobile, email FROM {{src_a}}), b AS (SELECT {FOLD % 'person_name'} AS k, mobile, email FROM {{src_b}}),
    v AS (SELECT k, 'phones' AS field, unnest(regexp_extract_all(COALESCE(mobile, ''), '[0-9]{{5,}}')) AS value, 'a' AS side FROM a UNION SELECT k, 'phones', unnest(regexp_extract_all(COALESCE(mobile, ''), '[0-9]{{5,}}')), 'b' FROM b
      UNION SELECT k, 'emails', unnest(regexp_extract_all(lower(COALESCE(email, '')), '{EMAIL}')), 'a' FROM a UNION SELECT k, 'emails', unnest(regexp_extract_all(lower(COALESCE(email, '')), '{EMAIL}')), 'b' FROM b),
    s AS (SELECT k, field, value, bool_or(side = 'a') AS in_a, bool_or(side = 'b') AS in_b FROM v GROUP BY 1, 2, 3)"""


def _sided_people(t):
    key = tx.folded(F.col("person_name")).alias("k")
    sets = {
        "phones": (tx.phone_set(F.col("mobile")), tx.phone_set(F.col("mobile"))),
        "emails": (tx.email_set(F.col("email")), tx.email_set(F.col("email"))),
    }
    return t.src_a.select(key, "mobile", "email"), t.src_b.select(key, "mobile", "email"), sets


@query(
    "e2_set_diff",
    SETS_SQL + """ SELECT k, field, count_if(in_a AND in_b) AS n_shared, count_if(in_a AND NOT in_b) AS n_a_only, count_if(NOT in_a AND in_b) AS n_b_only
       FROM s WHERE k IN (SELECT k FROM a) AND k IN (SELECT k FROM b) GROUP BY 1, 2 HAVING count_if(in_a <> in_b) > 0""",
)
def e2(t):
    a, b, sets = _sided_people(t)
    return rc.set_diff(a, b, ["k"], sets)


@query("e2_set_values", SETS_SQL + " SELECT k, field, value, in_a, in_b FROM s")
def e2_values(t):
    a, b, sets = _sided_people(t)
    return rc.set_values(a, b, ["k"], sets)


@query(
    "e3_perfect_groups",
    """SELECT o.org_id, count(f.person_id) AS n_findings, count(f.person_id) = 0 AS is_perfect FROM {org} o LEFT JOIN {person} f ON f.org_id = o.org_id AND f.balance BETWEEN 0 AND 150 GROUP BY 1""",
)
def e3(t):
    return rc.perfect_groups(t.org.select("org_id"), t.person.where("balance BETWEEN 0 AND 150"), "org_id")


FIELDS = [rc.Field("title"), rc.Field("mobile", "phone"), rc.Field("email", "email"), rc.Field("region")]
PHONES = "regexp_extract_all(COALESCE(%s, ''), '[0-9]{5,}')"


def _match(kind, a, b):
    if kind == "phone":
        return f"""CASE WHEN len({PHONES % a}) = 0 THEN {FOLD % a} = '' OR contains({FOLD % b}, {FOLD % a}) ELSE len(list_filter({PHONES % a}, lambda x: NOT list_contains({PHONES % b}, x))) = 0 END"""
    if kind == "email":
        return f"CASE WHEN {FOLD % a} = '' THEN {FOLD % b} = '' ELSE contains({FOLD % b}, {FOLD % a}) END"
    return f"{FOLD % a} = {FOLD % b}"


FIELD_SQL = f"""WITH a AS (SELECT * FROM (SELECT *, {FOLD % 'person_name'} AS k, row_number() OVER (PARTITION BY org_id, {FOLD % 'person_name'} ORDER BY person_id) rn FROM {{src_a}}) WHERE rn = 1),
    b AS (SELECT * FROM (SELECT *, {FOLD % 'person_name'} AS k, row_number() OVER (PARTITION BY org_id, {FOLD % 'person_name'} ORDER BY person_id) rn FROM {{src_b}}) WHERE rn = 1)"""
FIELD_DIFF_SQL = (
    FIELD_SQL
    + ", d AS ("
    + " UNION ALL ".join(
        f"""SELECT a.org_id, a.k, '{f}' AS field, a.{f} AS a_value, b.{f} AS b_value, CASE WHEN {_match(kind, 'a.' + f, 'b.' + f)} THEN 'yes' ELSE 'no' END AS match FROM a JOIN b ON a.org_id IS NOT DISTINCT FROM b.org_id AND a.k = b.k"""
        for f, kind in (("title", "text"), ("mobile", "phone"), ("email", "email"))
    )
    + """ UNION ALL SELECT a.org_id, a.k, 'region', NULL, 'r' || CAST(b.org_id AS STRING), 'not_comparable' FROM a JOIN b ON a.org_id IS NOT DISTINCT FROM b.org_id AND a.k = b.k
         UNION ALL SELECT org_id, k, '(record)', NULL, NULL, 'a_only' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.org_id IS NOT DISTINCT FROM a.org_id AND b.k = a.k)
         UNION ALL SELECT org_id, k, '(record)', NULL, NULL, 'b_only' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.org_id IS NOT DISTINCT FROM a.org_id AND b.k = a.k))"""
)


def _field_diff(t):
    key = tx.folded(F.col("person_name"))
    a, b = t.src_a.withColumn("k", key), t.src_b.withColumn("k", key)
    b = b.withColumn("region", F.concat(F.lit("r"), F.col("org_id").cast("string")))
    return rc.field_diff(a, b, ["org_id", "k"], "person_id", FIELDS)


@query("e4_field_diff", FIELD_DIFF_SQL + " SELECT org_id, k, field, a_value, b_value, match FROM d")
def e4(t):
    return _field_diff(t)


PAIR = """SELECT place_id, phone, email, raw_label, CASE WHEN org_id < 5 THEN replace(phone, ' / ', '') WHEN org_id < 10 THEN phone || ' / 91234567' WHEN org_id < 14 THEN '' ELSE phone END AS b_phone,
    CASE WHEN org_id < 6 THEN upper(email) || '; x@y.org' WHEN org_id < 9 THEN 'other@y.org' ELSE email END AS b_email, lower(label) AS b_label FROM {place}"""


@query(
    "e5_compare_expr",
    f"""SELECT place_id, {_match('phone', 'phone', 'b_phone')} AS phone_ok,
          CASE WHEN len({PHONES % 'phone'}) = 0 THEN {FOLD % 'phone'} = '' OR contains({FOLD % 'b_phone'}, {FOLD % 'phone'}) ELSE contains(array_to_string({PHONES % 'b_phone'}, ''), array_to_string({PHONES % 'phone'}, '')) END AS phone_joined_ok,
          {_match('email', 'email', 'b_email')} AS email_ok, {_match('text', 'raw_label', 'b_label')} AS label_ok FROM ({PAIR})""",
)
def e5(t):
    p = t.spark.sql(PAIR, place=t.place)
    cmp = rc.compare_expr
    return p.select(
        "place_id",
        cmp("phone", F.col("phone"), F.col("b_phone")).alias("phone_ok"),
        cmp("phone", F.col("phone"), F.col("b_phone"), joined=True).alias("phone_joined_ok"),
        cmp("email", F.col("email"), F.col("b_email")).alias("email_ok"),
        cmp("text", F.col("raw_label"), F.col("b_label")).alias("label_ok"),
    )


def _set(fn, col):
    pattern, src = ("[0-9]{5,}", f"COALESCE({col}, '')") if fn == "phone" else (EMAIL, f"lower(COALESCE({col}, ''))")
    return f"array_to_string(list_sort(list_distinct(regexp_extract_all({src}, '{pattern}'))), ', ')"


ENTITY_SQL = (
    FIELD_SQL
    + f""", j AS (SELECT a.org_id, a.k, a.title AS ta, b.title AS tb, {_set('phone', 'a.mobile')} AS pa, {_set('phone', 'b.mobile')} AS pb, {_set('email', 'a.email')} AS ea, {_set('email', 'b.email')} AS eb
          FROM a JOIN b ON a.org_id IS NOT DISTINCT FROM b.org_id AND a.k = b.k),
      i AS (SELECT org_id, k, 'title' AS issue, tb AS current, ta AS expected FROM j WHERE lower(ta) <> lower(tb) AND trim(ta) <> '' AND trim(tb) <> ''
        UNION ALL SELECT org_id, k, 'phone', pb, pa FROM j WHERE pa <> '' AND pb <> '' AND pa <> pb UNION ALL SELECT org_id, k, 'phone_blank', pb, pa FROM j WHERE pa <> '' AND pb = ''
        UNION ALL SELECT org_id, k, 'email', eb, ea FROM j WHERE ea <> '' AND eb <> '' AND ea <> eb UNION ALL SELECT org_id, k, 'email_blank', eb, ea FROM j WHERE ea <> '' AND eb = ''
        UNION ALL SELECT org_id, k, 'missing', NULL, NULL FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.org_id IS NOT DISTINCT FROM a.org_id AND b.k = a.k)
        UNION ALL SELECT org_id, k, 'extra', NULL, NULL FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.org_id IS NOT DISTINCT FROM a.org_id AND b.k = a.k))"""
)


def _entities(t, **kw):
    key = tx.folded(F.col("person_name"))
    return rc.compare_entities(
        t.src_a.withColumn("k", key), t.src_b.withColumn("k", key), ["org_id", "k"], "person_id",
        title="title", phone="mobile", email="email", **kw,
    )


@query("e6_compare_entities", ENTITY_SQL + ' SELECT org_id, k, issue, "current", expected FROM i')
def e6(t):
    return _entities(t)


@query("e6_compare_entities_found_only", ENTITY_SQL + " SELECT org_id, k, issue, \"current\", expected FROM i WHERE issue <> 'missing'")
def e6_found(t):
    return _entities(t, report_missing=False)


WRONG_SQL = f"""WITH a AS (SELECT DISTINCT org_id, {FOLD % 'person_name'} AS k FROM {{src_a}} UNION SELECT DISTINCT (org_id + 3) % 25, {FOLD % 'person_name'} FROM {{src_a}} WHERE title = 'General Manager'),
    w AS (SELECT k, count(*) AS n, min(org_id) AS o FROM a GROUP BY 1),
    b AS (SELECT *, {FOLD % 'person_name'} AS k FROM {{src_b}})
    SELECT b.person_id, b.person_name, b.org_id AS current_group, CASE WHEN w.n = 1 THEN w.o END AS expected_group, CASE WHEN w.n IS NULL THEN 'not_found' WHEN w.n = 1 THEN 'wrong_group' ELSE 'ambiguous' END AS status
    FROM b LEFT JOIN w ON w.k = b.k WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.org_id IS NOT DISTINCT FROM b.org_id AND a.k = b.k)"""


def _wrong_group(t):
    a = t.src_a.select("org_id", "person_name").union(
        t.src_a.where("title = 'General Manager'").selectExpr("(org_id + 3) % 25", "person_name")
    )
    return rc.wrong_group(a, t.src_b, "org_id", "person_name", "person_id")


@query("e7_wrong_group", WRONG_SQL)
def e7(t):
    return _wrong_group(t)


KEYED = """SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS k FROM {finding} WHERE category IN ('Control Room', 'Switchyard')"""
ARTIFACT_SQL = f"""WITH f AS ({KEYED}), n AS (SELECT *, row_number() OVER (PARTITION BY station, category, k, issue ORDER BY finding_id) AS rn FROM f),
    eq AS (SELECT m.finding_id AS missing_id, e.finding_id AS extra_id FROM n m JOIN n e ON m.issue = 'Missing' AND e.issue = 'Extra' AND m.station = e.station AND m.category = e.category AND m.k = e.k AND m.rn = e.rn AND m.k <> ''),
    rm AS (SELECT *, row_number() OVER (PARTITION BY station, category ORDER BY finding_id) AS r2 FROM f WHERE issue = 'Missing' AND k = 'control room' AND category = 'Control Room' AND finding_id NOT IN (SELECT missing_id FROM eq)),
    re AS (SELECT *, row_number() OVER (PARTITION BY station, category ORDER BY finding_id) AS r2 FROM f WHERE issue = 'Extra' AND trim(regexp_replace(lower(trim(regexp_replace(name, '^[0-9]+(\\.[0-9]+)*\\.?\\s*', ''))), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(station), '[^a-z0-9]+', ' ', 'g'))
           AND finding_id NOT IN (SELECT extra_id FROM eq)),
    art AS (SELECT missing_id, extra_id, 'equal label' AS pattern FROM eq UNION ALL SELECT rm.finding_id, re.finding_id, 'generic label' FROM rm JOIN re ON rm.station = re.station AND rm.category = re.category AND rm.r2 = re.r2)"""


@query("e8_pair_artifacts", ARTIFACT_SQL + " SELECT missing_id, extra_id, pattern FROM art")
def e8(t):
    return rc.pair_artifacts(t.finding)


NEAR = """SELECT CAST(p_partkey AS BIGINT) AS finding_id, p_brand AS station, 'Control Room' AS category, CASE WHEN p_size < 25 THEN 'Missing' ELSE 'Extra' END AS issue,
    CASE WHEN p_size < 20 THEN p_name || ' bay ' || CAST(p_size AS STRING) WHEN p_size < 40 THEN replace(p_name, 'e', 'a') || ' bay ' || CAST(p_size - 15 AS STRING) ELSE p_name || ' bay line' END AS name FROM {part}"""


# Best-first assignment along the edges ed (blk, a_name, b_name, score), one edge a step, of the copies in
# am and be (blk, name, id); pr holds the pairs of rows.
GREEDY_SQL = """ca AS (SELECT blk, name, count(*) AS n FROM am GROUP BY 1, 2), cb AS (SELECT blk, name, count(*) AS n FROM be GROUP BY 1, 2),
    e AS (SELECT ed.*, ca.n AS na, cb.n AS nb, row_number() OVER (PARTITION BY ed.blk ORDER BY score, md5(a_name || chr(1) || b_name), a_name, b_name) AS i
      FROM ed JOIN ca ON ca.blk = ed.blk AND ca.name = a_name JOIN cb ON cb.blk = ed.blk AND cb.name = b_name),
    g AS (SELECT DISTINCT blk, CAST(0 AS BIGINT) AS i, CAST(MAP {} AS MAP(VARCHAR, BIGINT)) AS ua, CAST(MAP {} AS MAP(VARCHAR, BIGINT)) AS ub, CAST(NULL AS VARCHAR) AS a_name, CAST(NULL AS VARCHAR) AS b_name,
        CAST(0 AS BIGINT) AS fa, CAST(0 AS BIGINT) AS fb, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS score FROM e
      UNION ALL SELECT blk, i, map_concat(ua, MAP([a_name], [fa + k])), map_concat(ub, MAP([b_name], [fb + k])), a_name, b_name, fa, fb, k, score FROM (
        SELECT *, greatest(0, least(na - fa, nb - fb)) AS k FROM (SELECT e.blk, e.i, g.ua, g.ub, e.a_name, e.b_name, e.score, e.na, e.nb, COALESCE(g.ua[e.a_name], 0) AS fa, COALESCE(g.ub[e.b_name], 0) AS fb
          FROM g JOIN e ON e.blk = g.blk AND e.i = g.i + 1))),
    ra AS (SELECT *, row_number() OVER (PARTITION BY blk, name ORDER BY id) AS rn FROM am), rb AS (SELECT *, row_number() OVER (PARTITION BY blk, name ORDER BY id) AS rn FROM be),
    pr AS (SELECT ra.id AS missing_id, rb.id AS extra_id, g.score FROM g JOIN ra ON ra.blk = g.blk AND ra.name = g.a_name AND ra.rn > g.fa AND ra.rn <= g.fa + g.k
      JOIN rb ON rb.blk = g.blk AND rb.name = g.b_name AND rb.rn = ra.rn - g.fa + g.fb)"""


@query(
    "e9_pair_fuzzy",
    f"""WITH RECURSIVE f AS (SELECT finding_id AS id, issue, station || '|' || category AS blk, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS name FROM ({NEAR})),
    am AS (SELECT * FROM f WHERE issue = 'Missing' AND length(name) >= 4), be AS (SELECT * FROM f WHERE issue = 'Extra' AND length(name) >= 4),
    ed AS (SELECT * FROM (SELECT DISTINCT am.blk, am.name AS a_name, be.name AS b_name, 1 - (1 - levenshtein(am.name, be.name) / greatest(length(am.name), length(be.name))) AS score FROM am JOIN be ON be.blk = am.blk) WHERE 1 - score >= 0.88),
    {GREEDY_SQL} SELECT missing_id, extra_id, round(1 - score, 4) AS similarity FROM pr""",
)
def e9(t):
    return rc.pair_fuzzy(t.spark.sql(NEAR, part=t.part))


@query(
    "e9_pair_blocks",
    f"""WITH RECURSIVE f AS (SELECT finding_id AS id, issue, station || '|' || category AS blk, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS name FROM ({NEAR})),
    am AS (SELECT * FROM f WHERE issue = 'Missing' AND length(name) >= 4), be AS (SELECT * FROM f WHERE issue = 'Extra' AND length(name) >= 4),
    pairs AS (SELECT DISTINCT am.name AS a_name, be.name AS b_name FROM am JOIN be ON be.blk = am.blk WHERE levenshtein(am.name, be.name) <= (1 - 0.9) * (length(am.name) + length(be.name)) + 1),
    {RATIOS_SQL}, ed AS (SELECT DISTINCT am.blk, a_name, b_name, 1 - ratio AS score FROM ratios JOIN am ON am.name = a_name JOIN be ON be.name = b_name AND be.blk = am.blk WHERE ratio >= 0.9),
    {GREEDY_SQL} SELECT missing_id, extra_id, round(1 - score, 4) AS similarity FROM pr""",
)
def e9_blocks(t):
    return rc.pair_fuzzy(t.spark.sql(NEAR, part=t.part), 0.9, blocks=True)


SHORT = """SELECT CAST(p_partkey AS BIGINT) AS finding_id, p_brand AS station, 'Control Room' AS category, CASE WHEN p_size < 25 THEN 'Missing' ELSE 'Extra' END AS issue,
    CASE WHEN p_size % 5 = 0 THEN ' ' || substr(p_name, 1, 1 + CAST(p_size % 4 AS INT)) || '-' WHEN p_size % 7 = 0 THEN '--' ELSE p_name END AS name FROM {part}"""


@query(
    "e9_short_findings",
    f"""SELECT finding_id, station, category, issue, name, 'too short' AS status FROM ({SHORT.replace('{part}', 'part')}) WHERE length(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))) BETWEEN 1 AND 3""",
)
def e9_short(t):
    return rc.short_findings(t.spark.sql(SHORT, part=t.part))


FORMATS = """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '+91 ' || CAST(9810000000 + o_custkey AS STRING) ELSE CAST(9810000000 + o_custkey AS STRING) || ' / 22' END AS a_phone,
    CASE o_orderstatus WHEN 'O' THEN '0' || CAST(9810000000 + o_custkey AS STRING) WHEN 'F' THEN CAST(9820000000 + o_custkey AS STRING) || ', 022' ELSE '' END AS b_phone FROM {orders}"""


def _lenient(c):
    d = f"regexp_replace(regexp_replace(x, '[^0-9]+', '', 'g'), '^0+', '')"
    z = f"CASE WHEN length({d}) > 10 AND starts_with({d}, '91') THEN substr({d}, 3) ELSE {d} END"
    return f"list_filter(list_transform(regexp_split_to_array({c}, '[/;,]'), lambda x: nullif(right({z}, 10), '')), lambda y: y IS NOT NULL)"


@query("e10_format_only", f"SELECT o_orderkey, a_phone, b_phone, list_has_any({_lenient('a_phone')}, {_lenient('b_phone')}) AS format_only FROM ({FORMATS})")
def e10(t):
    return rc.format_only(t.spark.sql(FORMATS, orders=t.orders), "a_phone", "b_phone")


@query(
    "e11_issue_origin",
    """WITH a AS (SELECT DISTINCT user_id AS grp, event_type AS issue FROM events WHERE value > 70 AND event_type <> 'view'), b AS (SELECT DISTINCT user_id AS grp, event_type AS issue FROM events WHERE value < 1.5),
         j AS (SELECT COALESCE(a.grp, b.grp) AS grp, a.issue AS ia, b.issue AS ib FROM a FULL JOIN b ON a.grp = b.grp AND a.issue = b.issue),
         n AS (SELECT grp, count(ia) AS n_source, count(ib) AS n_store, count_if(ia IS NOT NULL AND ib IS NOT NULL) AS n_both FROM j GROUP BY 1)
       SELECT *, CASE WHEN n_both > 0 AND n_both = n_store THEN 'in source' WHEN n_store > 0 AND n_source = 0 THEN 'introduced' WHEN n_store > 0 AND n_source > 0 THEN 'mixed' ELSE 'source only' END AS origin FROM n""",
)
def e11(t):
    a = t.events.where("value > 70 AND event_type <> 'view'").selectExpr("user_id AS grp", "event_type AS issue")
    b = t.events.where("value < 1.5").selectExpr("user_id AS grp", "event_type AS issue")
    return rc.issue_origin(a, b, "grp", "issue")


TRIAGE = [
    rc.Triage(Rule("False Positive", "station", equals=("Brand#3", "Brand#9")), "High"),
    rc.Triage(Rule("False Positive", "name", equals=("Control Room",)), "Medium"),
    rc.Triage(Rule("Warning", "name", regex=r"(?i)\b(widget|ring)\b", unless=("hot",)), "Medium"),
    rc.Triage(Rule("Warning", "category", equals=("Employee",)), "Medium"),
]


@query(
    "e12_triage",
    """SELECT finding_id, CASE WHEN station IN ('Brand#3', 'Brand#9') THEN 'False Positive' WHEN name = 'Control Room' THEN 'False Positive' ELSE 'Warning' END AS triage_class,
         CASE WHEN station IN ('Brand#3', 'Brand#9') THEN 'High' WHEN name = 'Control Room' THEN 'Medium' WHEN regexp_matches(lower(name), '\\b(widget|ring)\\b') AND NOT contains(lower(name), 'hot') THEN 'Medium'
              WHEN category = 'Employee' THEN 'Medium' ELSE 'Low' END AS confidence FROM {finding}""",
)
def e12(t):
    return rc.triage(t.finding, TRIAGE).select("finding_id", "triage_class", "confidence")


@query(
    "e13_recon_summary",
    ENTITY_SQL
    + """, c AS (SELECT count_if(issue IN ('title', 'phone', 'email')) AS incorrect, count_if(issue = 'missing') AS missing, count_if(issue = 'extra') AS manual FROM i),
         n AS (SELECT count(*) AS total, count_if(trim(COALESCE(email, '')) <> '') AS confident FROM {src_b}), x AS (SELECT *, greatest(total - incorrect - missing - manual, 0) AS correct FROM c, n)
       SELECT incorrect, missing, manual, total, confident, correct, round(100.0 * correct / (correct + incorrect + manual), 2)::DOUBLE AS accuracy_pct, round(100.0 * confident / total, 2)::DOUBLE AS confidence_pct FROM x""",
)
def e13(t):
    total = t.src_b.withColumn("is_confident", ~tx.is_blank(F.col("email")))
    out = rc.recon_summary(total, _entities(t), ["title", "phone", "email"], ["missing"], ["extra"])
    return out.withColumns({c: F.col(c).cast("double") for c in ("accuracy_pct", "confidence_pct")}).withColumn(
        "correct", F.col("correct").cast("bigint")
    )


MOVES = "SELECT finding_id, station, issue, name || CAST(finding_id % 300 AS STRING) AS name FROM {finding}"


@query(
    "e14_suggest_moves",
    f"""WITH f AS (SELECT *, lower(trim(name)) AS k FROM ({MOVES})), p AS (SELECT k, count_if(issue = 'Missing') AS m, count_if(issue = 'Extra') AS e, min(CASE WHEN issue = 'Missing' THEN station END) AS t, min(CASE WHEN issue = 'Extra' THEN station END) AS s FROM f GROUP BY 1),
         x AS (SELECT p.*, t IN (SELECT p_brand FROM part WHERE p_size > 48 AND p_brand <> 'Brand#5') AS known, EXISTS (SELECT 1 FROM f r WHERE r.station = p.s AND r.k = p.k AND NOT contains(r.name, '2')) AS held FROM p)
        SELECT k AS name_key, CASE WHEN m > 0 AND e > 0 THEN 'move' ELSE 'ignore' END AS action, CASE WHEN m = 1 AND e = 1 AND known AND held THEN 'HIGH' WHEN m = 1 AND e = 1 THEN 'LOW' WHEN m > 0 AND e > 0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
          CASE WHEN m = 1 AND e = 1 AND NOT known THEN 'target station unknown' WHEN m = 1 AND e = 1 AND NOT held THEN 'source row not found' WHEN m = 1 AND e = 1 THEN 'one Missing and one Extra' WHEN m > 0 AND e > 0 THEN 'several candidates' WHEN m > 0 THEN 'Missing only' ELSE 'Extra only' END AS reason,
          CASE WHEN m = 1 AND e = 1 THEN s END AS from_station, CASE WHEN m = 1 AND e = 1 THEN t END AS to_station, m AS n_missing, e AS n_extra FROM x""",
)
def e14(t):
    found = t.spark.sql(MOVES, finding=t.finding)
    stations = t.place.join(t.part.where("p_size > 48 AND p_brand <> 'Brand#5'").selectExpr("p_partkey AS place_id"), "place_id", "left_semi")
    return rc.suggest_moves(found, stations.select("station"), found.where("NOT contains(name, '2')"))


@query(
    "e15_suggest_merges",
    """SELECT org_id, lower(label) AS name_key, count(*) AS n_rows, count(DISTINCT lower(station)) AS n_titles, CASE WHEN count(DISTINCT lower(station)) = 1 THEN 'HIGH' ELSE 'LOW' END AS confidence
       FROM {place} GROUP BY 1, 2 HAVING count(*) > 1""",
)
def e15(t):
    return rc.suggest_merges(t.place, "org_id", "label", "station")


@query(
    "e16_suggest_place_moves",
    f"""WITH RECURSIVE f AS (SELECT finding_id AS id, issue, category AS blk, station || ' ' || left(name, 1) AS station, lower(station || ' ' || left(name, 1)) AS name FROM {{finding}} WHERE category = 'Control Room'),
    am AS (SELECT * FROM f WHERE issue = 'Missing'), be AS (SELECT * FROM f WHERE issue = 'Extra'),
    ed AS (SELECT DISTINCT am.blk, am.name AS a_name, be.name AS b_name, CAST(abs(length(am.name) - length(be.name)) AS DOUBLE) AS score FROM am JOIN be ON contains(am.name, be.name) OR contains(be.name, am.name)),
    {GREEDY_SQL} SELECT am.id AS missing_id, am.station, pr.extra_id, 'LOW' AS confidence FROM am LEFT JOIN pr ON pr.missing_id = am.id""",
)
def e16(t):
    places = t.finding.withColumn("station", F.concat_ws(" ", "station", F.substring("name", 1, 1)))
    return rc.suggest_place_moves(places, "Control Room")


@query(
    "e17_pending",
    """SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND ((quality = 1 AND toxic = 0) OR (quality = 0 AND toxic = 1)))""",
)
def e17(t):
    decision = F.when(F.expr("quality = 1 AND toxic = 0"), "approved").when(F.expr("quality = 0 AND toxic = 1"), "rejected").otherwise("skipped")
    return rc.pending(t.documents.select("doc_id", "source"), t.labels.withColumn("decision", decision), ["doc_id"])


BATCH_SQL = FIELD_DIFF_SQL + """, p AS (SELECT CASE WHEN match = 'a_only' THEN 'insert' ELSE 'update ' || field END AS batch, org_id, k, b_value AS current_value, a_value AS proposed_value FROM d
    WHERE match = 'a_only' OR (match = 'no' AND field IN ('title', 'mobile') AND lower(trim(COALESCE(a_value, ''))) NOT IN ('', '-', '--', 'na', 'n/a', 'n a', 'nil', 'none')))"""


def _batches(t):
    return rc.proposal_batches(_field_diff(t), ["org_id", "k"], ["title", "mobile"])


@query("e18_proposal_batches", BATCH_SQL + " SELECT * FROM p")
def e18(t):
    return _batches(t)


@query("e18_batch_sample", BATCH_SQL + " SELECT * FROM p WHERE batch = 'update mobile' ORDER BY org_id NULLS FIRST, k LIMIT 20")
def e18_sample(t):
    return rc.batch_sample(_batches(t), "update mobile", ["org_id", "k"], n=20)


@query("e18_one_sided_counts", FIELD_DIFF_SQL + " SELECT match, count(*) AS n_records FROM d WHERE match IN ('a_only', 'b_only') GROUP BY 1")
def e18_counts(t):
    return rc.one_sided_counts(_field_diff(t))


@query(
    "e19_missing_rows",
    """WITH a AS (SELECT DISTINCT l_orderkey AS ref_id, CASE WHEN l_suppkey % 9 > 0 THEN CAST(l_suppkey AS STRING) END AS value FROM lineitem WHERE l_linestatus = 'O'), b AS (SELECT o_orderkey AS row_id, l_orderkey AS ref_id, CASE WHEN l_suppkey % 9 > 0 THEN CAST(l_suppkey AS STRING) END AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A')
       SELECT (SELECT max(row_id) FROM b) + row_number() OVER (ORDER BY ref_id, value NULLS FIRST) AS row_id, ref_id, value FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.ref_id = a.ref_id AND b.value IS NOT DISTINCT FROM a.value)""",
)
def e19(t):
    lines = t.lineitem.selectExpr("l_orderkey AS ref_id", "CASE WHEN l_suppkey % 9 > 0 THEN CAST(l_suppkey AS STRING) END AS value", "l_linestatus", "l_returnflag")
    b = lines.where("l_returnflag = 'A'").join(t.orders.selectExpr("o_orderkey AS row_id"), F.col("ref_id") == F.col("row_id"))
    return rc.missing_rows(lines.where("l_linestatus = 'O'"), b.select("row_id", "ref_id", "value"), ["ref_id", "value"], "row_id")


@query(
    "e20_verified_reassign",
    f"""WITH a AS (SELECT DISTINCT org_id AS station, {FOLD % 'person_name'} AS k FROM {{src_a}} UNION SELECT DISTINCT (org_id + 3) % 25, {FOLD % 'person_name'} FROM {{src_a}} WHERE title = 'General Manager'),
         b AS (SELECT *, {FOLD % 'person_name'} AS k FROM {{src_b}} UNION ALL SELECT *, {FOLD % 'person_name'} AS k FROM (SELECT person_id + 700000000 AS person_id, (org_id + 2) % 25 AS org_id, person_name, title, mobile, email FROM {{src_b}} WHERE title = 'Manager')),
         w AS (SELECT k, count(*) AS n, min(station) AS s FROM a GROUP BY 1)
        SELECT person_id, org_id AS from_station, CASE WHEN st = 'reassign' THEN s END AS to_station, st AS status FROM (SELECT b.person_id, b.org_id, w.s, CASE WHEN w.n IS NULL THEN 'review: not in source' WHEN w.n > 1 THEN 'review: several stations' WHEN w.s IS NOT DISTINCT FROM b.org_id THEN 'in place'
          WHEN EXISTS (SELECT 1 FROM b x WHERE x.k = b.k AND x.org_id IS NOT DISTINCT FROM w.s) THEN 'review: already held' ELSE 'reassign' END AS st FROM b LEFT JOIN w ON w.k = b.k)""",
)
def e20(t):
    a = t.src_a.select("org_id", "person_name").union(
        t.src_a.where("title = 'General Manager'").selectExpr("(org_id + 3) % 25", "person_name")
    )
    moved = t.src_b.where("title = 'Manager'").selectExpr(
        "person_id + 700000000 AS person_id", "(org_id + 2) % 25 AS org_id", "person_name", "title", "mobile", "email"
    )
    return rc.verified_reassign(a, t.src_b.unionByName(moved), "person_name", "org_id", "person_id")
