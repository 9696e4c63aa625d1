"""Bindings: joins and resolution."""

from pyspark.sql import functions as F

from rosterloom.functions import text as tx
from rosterloom.operators import resolve as rs

from .tables import RATIOS_SQL, query

STRIP = r"""lower(trim(regexp_replace(CASE WHEN starts_with(raw_label, 'M/s ') THEN substr(raw_label, 5) ELSE raw_label END, '^[0-9]+(\.[0-9]+)*\.?\s*', '')))"""


def _label_key():
    return F.lower(tx.strip_serial(tx.strip_prefixes(F.col("raw_label"), ["M/s "])))


@query(
    "d1_match_exact",
    f"""WITH a AS (SELECT place_id, {STRIP} AS key FROM {{place}}), d AS (SELECT label AS key, min(place_id) AS dict_id FROM {{place}} GROUP BY 1)
        SELECT place_id, a.key, dict_id FROM a LEFT JOIN d ON d.key = a.key""",
)
def d1(t):
    words = t.place.selectExpr("label", "place_id AS dict_id")
    return rs.match_exact(t.place.select("place_id", _label_key().alias("key")), "key", words, "dict_id", "label")


STATION = "CASE WHEN p_size < 25 THEN 'nation_' || CAST(p_size AS STRING) || ' ' || p_name ELSE 'nation_' || CAST(p_size AS STRING) END"
CONTAINS_SQL = """SELECT key, org_id, org_name AS name, gap FROM (SELECT k.key, d.org_id, d.org_name, abs(length(k.key) - length(d.org_name)) AS gap,
    row_number() OVER (PARTITION BY k.key ORDER BY abs(length(k.key) - length(d.org_name)), d.org_id) AS rn
    FROM k JOIN d ON (contains(k.key, d.org_name) OR contains(d.org_name, k.key)) WHERE length(k.key) >= 4 AND length(d.org_name) >= 4) WHERE rn = 1"""


@query(
    "d2_match_contains",
    f"""WITH k AS (SELECT DISTINCT {STATION} AS key FROM part), d AS (SELECT org_id, lower(org_name) AS org_name FROM {{org}}) {CONTAINS_SQL}""",
)
def d2(t):
    keys = t.part.select(F.expr(STATION).alias("key")).distinct()
    names = t.org.select("org_id", F.lower("org_name").alias("org_name"))
    return rs.match_contains(keys, "key", names, "org_id", "org_name").withColumn("gap", F.col("gap").cast("bigint"))


@query(
    "d2_match_contains_wide",
    """WITH k AS (SELECT DISTINCT 'unit ' || CAST(o_custkey AS STRING) || CAST(o_orderkey % 10 AS STRING) AS key FROM orders),
            d AS (SELECT person_id AS org_id, 'unit ' || CAST(person_id AS STRING) AS org_name FROM {person})
       SELECT key, org_id, org_name AS name, gap FROM (SELECT k.key, d.org_id, d.org_name, abs(length(k.key) - length(d.org_name)) AS gap,
         row_number() OVER (PARTITION BY k.key ORDER BY abs(length(k.key) - length(d.org_name)), d.org_id) AS rn
         FROM k JOIN d ON (contains(k.key, d.org_name) OR contains(d.org_name, k.key))) WHERE rn = 1""",
)
def d2_wide(t):
    """A dictionary as large as the people table; all names share a prefix."""
    keys = t.orders.selectExpr(
        "'unit ' || CAST(o_custkey AS STRING) || CAST(o_orderkey % 10 AS STRING) AS key"
    )
    names = t.person.selectExpr("person_id AS org_id", "'unit ' || CAST(person_id AS STRING) AS org_name")
    return rs.match_contains(keys.distinct(), "key", names, "org_id", "org_name").withColumn("gap", F.col("gap").cast("bigint"))


TIERED = """CASE WHEN p_size < 10 THEN lower(p_type) || ' nation_' || CAST(p_size AS STRING) WHEN p_size < 30 THEN 'nation_' || CAST(p_size AS STRING)
    WHEN p_size < 35 THEN 'asia' WHEN p_size < 40 THEN 'north america' ELSE p_name END"""


def _hit(kind, src):
    on = "k.key = d.org_name" if kind == "exact" else "length(k.key) >= 4 AND length(d.org_name) >= 4 AND (contains(k.key, d.org_name) OR contains(d.org_name, k.key))"
    rank = "d.org_id" if kind == "exact" else "abs(length(k.key) - length(d.org_name)), d.org_id"
    return f"""(SELECT key, org_id FROM (SELECT k.key, d.org_id, row_number() OVER (PARTITION BY k.key ORDER BY {rank}) rn FROM k JOIN {src} d ON {on}) WHERE rn = 1)"""


@query(
    "d3_match_station",
    f"""WITH a AS (SELECT p_partkey, {TIERED} AS key FROM part), k AS (SELECT DISTINCT key FROM a),
         c AS (SELECT org_id, lower(org_name) AS org_name FROM {{org}} WHERE parent_id IS NOT NULL), p AS (SELECT org_id, lower(org_name) AS org_name FROM {{org}} WHERE parent_id IS NULL)
        SELECT p_partkey, a.key, COALESCE(h1.org_id, h2.org_id, h3.org_id, h4.org_id) AS org_id,
          CASE WHEN h1.org_id IS NOT NULL THEN 'child exact' WHEN h2.org_id IS NOT NULL THEN 'parent exact' WHEN h3.org_id IS NOT NULL THEN 'child contains'
               WHEN h4.org_id IS NOT NULL THEN 'parent contains' ELSE 'none' END AS tier
        FROM a LEFT JOIN {_hit('exact', 'c')} h1 ON h1.key = a.key LEFT JOIN {_hit('exact', 'p')} h2 ON h2.key = a.key
        LEFT JOIN {_hit('contains', 'c')} h3 ON h3.key = a.key LEFT JOIN {_hit('contains', 'p')} h4 ON h4.key = a.key""",
)
def d3(t):
    names = t.org.select("org_id", F.lower("org_name").alias("org_name"), "parent_id")
    rows = t.part.select("p_partkey", F.expr(TIERED).alias("key"))
    return rs.match_station(
        rows, "key", names.where("parent_id IS NOT NULL"), names.where("parent_id IS NULL"), "org_id", "org_name"
    ).select("p_partkey", "key", "org_id", "tier")


@query(
    "d4_longest_name_in",
    f"""WITH x AS (SELECT DISTINCT {STATION} AS station FROM part), d AS (SELECT DISTINCT lower(n_name) AS name FROM nation UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part)
        SELECT station, name FROM (SELECT station, name, row_number() OVER (PARTITION BY station ORDER BY length(name) DESC, name) rn FROM x JOIN d ON contains(station, name)) WHERE rn = 1""",
)
def d4(t):
    stations = t.part.select(F.expr(STATION).alias("station"))
    names = t.nation.select(F.lower("n_name").alias("name")).union(t.part.select(F.split_part("p_name", F.lit(" "), F.lit(2))))
    return rs.longest_name_in(stations, "station", names.distinct(), "name")


@query(
    "d4_longest_name_in_documents",
    """WITH d AS (SELECT DISTINCT text AS name FROM benchmark WHERE text <> '' UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part)
       SELECT doc_id, name FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) rn
         FROM documents JOIN d ON contains(lower(text), lower(name))) WHERE rn = 1""",
)
def d4_documents(t):
    names = t.benchmark.select(F.col("text").alias("name")).where("name <> ''")
    names = names.union(t.part.select(F.split_part("p_name", F.lit(" "), F.lit(1)))).distinct()
    return rs.longest_name_in(t.documents, "text", names, "name", id_col="doc_id")


CASCADE = """SELECT person_id, CASE WHEN dept = 'BUILDING' THEN 'Lead ' || CAST(org_id AS STRING) ELSE person_name END AS person_name,
    CASE WHEN balance < 1000 THEN NULL WHEN balance < 2000 THEN org_id + 500 ELSE org_id END AS org_id,
    CASE WHEN balance < 700 THEN title || ', nation_' || CAST(org_id AS STRING) ELSE title END AS title,
    CASE WHEN balance BETWEEN 1500 AND 1800 THEN 1002 WHEN balance BETWEEN 1800 AND 2000 THEN 99 END AS parent_id FROM {person}"""


@query(
    "d5_assign_org",
    f"""WITH p AS ({CASCADE}), o AS (SELECT org_id, lower(org_name) AS org_name FROM {{org}}), ov AS (SELECT person_name, min(org_id) AS org_id FROM {{person}} WHERE balance BETWEEN 900 AND 1200 GROUP BY 1),
         it AS (SELECT title, org_id FROM (SELECT d.title, o.org_id, row_number() OVER (PARTITION BY d.title ORDER BY length(o.org_name) DESC, o.org_name) rn FROM (SELECT DISTINCT title FROM p) d JOIN o ON contains(lower(d.title), o.org_name)) WHERE rn = 1),
         sh AS (SELECT DISTINCT person_name FROM p WHERE org_id IN (SELECT org_id FROM o)),
         j AS (SELECT p.person_id, v.org_id AS valid, ov.org_id AS ov, it.org_id AS titled, sh.person_name AS shared, po.org_id AS par FROM p LEFT JOIN o v ON v.org_id = p.org_id LEFT JOIN ov ON ov.person_name = p.person_name
               LEFT JOIN it ON it.title = p.title LEFT JOIN sh ON sh.person_name = p.person_name LEFT JOIN o po ON po.org_id = p.parent_id)
        SELECT person_id, COALESCE(valid, ov, titled, CASE WHEN shared IS NULL THEN par END) AS org_id, CASE WHEN valid IS NOT NULL THEN 'valid id' WHEN ov IS NOT NULL THEN 'override' WHEN titled IS NOT NULL THEN 'name in title'
          WHEN shared IS NOT NULL THEN 'review: shared name' WHEN par IS NOT NULL THEN 'parent' ELSE 'review: nothing settles it' END AS reason FROM j""",
)
def d5(t):
    people = t.spark.sql(CASCADE, person=t.person)
    overrides = t.person.where("balance BETWEEN 900 AND 1200").select("person_name", "org_id")
    return rs.assign_org(people, t.org, overrides).select("person_id", "org_id", "reason")


TEXT_ID = """SELECT s_suppkey, CASE WHEN s_acctbal < 2000 THEN 'unknown' WHEN s_acctbal < 5000 THEN ' nation_' || CAST(s_nationkey AS STRING) ELSE 'NATION_' || CAST((s_nationkey + 1) % 25 AS STRING) END AS org_text,
    CAST(CASE WHEN s_acctbal < 1000 THEN 700 ELSE s_nationkey END AS BIGINT) AS org_ref FROM {supplier}"""


@query(
    "d6_resolve_text_vs_id",
    f"""SELECT s.s_suppkey, COALESCE(x.org_id, i.org_id) AS resolved_org_id, CASE WHEN x.org_id IS NOT NULL AND x.org_id = i.org_id THEN 'agree' WHEN x.org_id IS NOT NULL THEN 'text wins'
          WHEN i.org_id IS NOT NULL THEN 'id kept' ELSE 'review' END AS resolution FROM ({TEXT_ID}) s LEFT JOIN {{org}} x ON lower(x.org_name) = lower(trim(s.org_text)) LEFT JOIN {{org}} i ON i.org_id = s.org_ref""",
)
def d6(t):
    rows = t.spark.sql(TEXT_ID, supplier=t.supplier)
    return rs.resolve_text_vs_id(rows, "org_text", "org_ref", t.org).select("s_suppkey", "resolved_org_id", "resolution")


@query(
    "d7_ambiguous_keys",
    """WITH x AS (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice < 100000 THEN NULL ELSE o_orderkey END AS ref FROM orders)
       SELECT o_orderkey, o_custkey FROM x WHERE ref IS NULL AND EXISTS (SELECT 1 FROM x y WHERE y.o_custkey = x.o_custkey AND y.ref IS NOT NULL)""",
)
def d7(t):
    rows = t.orders.selectExpr("o_orderkey", "o_custkey", "CASE WHEN o_totalprice < 100000 THEN NULL ELSE o_orderkey END AS ref")
    return rs.ambiguous_keys(rows, "o_custkey", "ref").select("o_orderkey", "o_custkey")


@query(
    "d8_expand_children",
    """WITH m AS (SELECT org_id FROM {org} WHERE contains(lower(org_name), 'a') AND (contains(lower(org_name), 'asia') OR contains(lower(org_name), '_1')))
       SELECT org_id FROM m UNION SELECT org_id FROM {org} WHERE parent_id IN (SELECT org_id FROM m)""",
)
def d8(t):
    matched = t.org.where("contains(lower(org_name), 'asia') OR contains(lower(org_name), '_1')")
    return rs.expand_children(t.org, matched)


@query(
    "d9_with_dependents",
    """SELECT org_id, org_name, EXISTS (SELECT 1 FROM {person} p WHERE p.org_id = o.org_id AND p.dept = 'BUILDING' AND p.balance > 8800) AS has_dependents FROM {org} o""",
)
def d9(t):
    child = t.person.where("dept = 'BUILDING' AND balance > 8800")
    return rs.with_dependents(t.org, "org_id", child, "org_id").select("org_id", "org_name", "has_dependents")


SHIFTED = """SELECT doc_id, CASE WHEN lang = 'en' THEN text END AS phone, CASE WHEN lang <> 'en' AND NOT contains(text, '@') THEN text END AS email FROM {documents}"""
D_EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"


@query(
    "d10_relocate_by_content",
    f"""WITH r AS ({SHIFTED}), s AS (SELECT doc_id, CASE WHEN regexp_matches(phone, '{D_EMAIL}') THEN lower(regexp_extract(phone, '{D_EMAIL}'))
            WHEN regexp_matches(email, '[0-9]{{5,}}') THEN regexp_extract(email, '[0-9]{{5,}}') END AS anchor FROM r),
         c AS (SELECT source AS station, unnest(list_concat(regexp_extract_all(lower(text), '{D_EMAIL}'), regexp_extract_all(text, '[0-9]{{5,}}'))) AS anchor FROM documents),
         p AS (SELECT anchor, min(station) AS lo, max(station) AS hi FROM c GROUP BY 1)
        SELECT s.doc_id, s.anchor, CASE WHEN lo = hi THEN lo END AS station, CASE WHEN lo IS NULL THEN 'not found' WHEN lo = hi THEN 'relocated' ELSE 'review: several stations' END AS status
        FROM s LEFT JOIN p ON p.anchor = s.anchor WHERE s.anchor IS NOT NULL""",
)
def d10(t):
    rows = t.spark.sql(SHIFTED, documents=t.documents)
    cells = t.documents.selectExpr("source AS station", "text AS cell")
    return rs.relocate_by_content(rows, "doc_id", "phone", "email", cells)


@query(
    "d11_pair_occurrences",
    """WITH a AS (SELECT o_custkey AS k, o_orderpriority AS t, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS ca FROM orders WHERE o_orderstatus = 'O'),
            b AS (SELECT o_custkey AS k, o_orderpriority AS t, o_orderkey AS id, o_totalprice > 400000 AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n,
                  row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS tn FROM orders WHERE o_orderstatus = 'F'),
            bs AS (SELECT k, count(*) AS cb, min(id) AS f, count_if(c) AS cc, min(CASE WHEN c THEN id END) AS fc FROM b GROUP BY k), ts AS (SELECT k, t, count(*) AS ct, min(id) AS ft FROM b GROUP BY k, t)
       SELECT a.id AS order_id, a.k AS person_id, CASE WHEN cb IS NULL THEN NULL WHEN cb = 1 THEN f WHEN cb = ca THEN b1.id WHEN ct = ca THEN b2.id WHEN ct = 1 THEN ft WHEN cc = 1 THEN fc WHEN b1.id IS NOT NULL THEN b1.id ELSE f END AS partner_id,
              CASE WHEN cb IS NULL THEN 'missing' WHEN cb = 1 THEN 'unique-name' WHEN cb = ca THEN 'name-occurrence' WHEN ct = ca THEN 'title-occurrence' WHEN ct = 1 THEN 'name-and-title' WHEN cc = 1 THEN 'only-contact-row'
                   WHEN b1.id IS NOT NULL THEN 'partial-occurrence' ELSE 'ambiguous-first' END AS match_status
       FROM a LEFT JOIN bs ON bs.k = a.k LEFT JOIN ts ON ts.k = a.k AND ts.t = a.t LEFT JOIN b b1 ON b1.k = a.k AND b1.n = a.n LEFT JOIN b b2 ON b2.k = a.k AND b2.t = a.t AND b2.tn = a.n""",
)
def d11(t):
    cols = ["o_custkey AS person_id", "o_orderpriority AS title"]
    a = t.orders.where("o_orderstatus = 'O'").selectExpr(*cols, "o_orderkey AS order_id")
    b = t.orders.where("o_orderstatus = 'F'").selectExpr(*cols, "o_orderkey AS partner_id", "o_totalprice")
    return rs.pair_occurrences(a, b, "person_id", "title", "order_id", "partner_id", F.col("o_totalprice") > 400000)


FUZZY_A = "SELECT person_id, org_id, CASE WHEN balance < 3000 THEN replace(person_name, '0', 'O') WHEN balance < 6000 THEN replace(person_name, 'tomer', 'tmoer') ELSE substr(person_name, 2) END AS person_name FROM {person}"


@query(
    "d12_fuzzy_candidates",
    f"""WITH a AS (SELECT person_id, org_id, lower(person_name) AS a_name FROM ({FUZZY_A})), b AS (SELECT person_id AS match_id, org_id, lower(person_name) AS b_name FROM {{person}} WHERE balance > 0)
        SELECT person_id, org_id, a_name, match_id, b_name, round(sim, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY sim DESC, b_name, match_id) rn FROM (
          SELECT a.person_id, a.org_id, a_name, match_id, b_name, 1 - levenshtein(a_name, b_name) / greatest(length(a_name), length(b_name)) AS sim FROM a JOIN b ON a.org_id = b.org_id) WHERE sim >= 0.82) WHERE rn = 1""",
)
def d12(t):
    a = t.spark.sql(FUZZY_A, person=t.person)
    b = t.person.where("balance > 0").selectExpr("person_id AS match_id", "org_id", "person_name")
    return rs.fuzzy_candidates(a, "person_id", b, "match_id", "person_name", "org_id").withColumn(
        "similarity", F.round("similarity", 4)
    )


@query(
    "d12_fuzzy_blocks",
    f"""WITH RECURSIVE a AS (SELECT person_id, org_id, lower(person_name) AS a_name FROM ({FUZZY_A})), b AS (SELECT person_id AS match_id, org_id, lower(person_name) AS b_name FROM {{person}}),
        near AS (SELECT DISTINCT org_id, a_name, b_name FROM a JOIN b USING (org_id)), pairs AS (SELECT DISTINCT a_name, b_name FROM near WHERE levenshtein(a_name, b_name) <= (1 - 0.9) * (length(a_name) + length(b_name)) + 1),
        {RATIOS_SQL}
        SELECT person_id, org_id, a_name, match_id, b_name, round(ratio, 4) AS similarity FROM (SELECT a.*, match_id, b.b_name, ratio, row_number() OVER (PARTITION BY person_id ORDER BY ratio DESC, b.b_name, match_id) AS rn
          FROM a JOIN b USING (org_id) JOIN ratios r ON r.a_name = a.a_name AND r.b_name = b.b_name WHERE ratio >= 0.9) WHERE rn = 1""",
)
def d12_blocks(t):
    a = t.spark.sql(FUZZY_A, person=t.person)
    b = t.person.selectExpr("person_id AS match_id", "org_id", "person_name")
    return rs.fuzzy_candidates(a, "person_id", b, "match_id", "person_name", "org_id", 0.9, blocks=True).withColumn(
        "similarity", F.round("similarity", 4)
    )


SHORT_NAMES = "SELECT substr(lower(person_name), 7, 1 + CAST(person_id % 6 AS INT)) AS name FROM {person} UNION ALL SELECT substr(lower(n_name), 1, CAST(n_nationkey % 7 AS INT)) FROM {nation}"


@query("d13_short_names", f"SELECT DISTINCT name, 'too short' AS status FROM ({SHORT_NAMES.replace('{nation}', 'nation')}) WHERE length(name) BETWEEN 1 AND 3")
def d13_short(t):
    return rs.short_names(t.spark.sql(SHORT_NAMES, person=t.person, nation=t.nation), "name")


@query(
    "d13_containment_pairs",
    """WITH n AS (SELECT DISTINCT 'unit ' || CAST(person_id AS STRING) AS name FROM {person} UNION SELECT lower(n_name) FROM nation)
       SELECT k.name AS keep_name, d.name AS drop_name FROM n k JOIN n d ON contains(k.name, d.name) AND k.name <> d.name AND length(d.name) >= 4""",
)
def d13(t):
    names = t.person.selectExpr("'unit ' || CAST(person_id AS STRING) AS name").union(t.nation.selectExpr("lower(n_name)"))
    return rs.containment_pairs(names, "name")


@query(
    "d14_enrich",
    """SELECT p.person_id, p.person_name, o.org_name, q.org_name AS parent_name FROM (SELECT *, CASE WHEN balance < 0 THEN NULL ELSE org_id END AS org FROM {person}) p
       LEFT JOIN {org} o ON o.org_id = p.org LEFT JOIN {org} q ON q.org_id = o.parent_id""",
)
def d14(t):
    people = t.person.withColumn("org_id", F.when(F.col("balance") >= 0, F.col("org_id")))
    return rs.enrich(people, t.org).select("person_id", "person_name", "org_name", "parent_name")


@query(
    "d15_first_per_key",
    """SELECT person_id, request_id, field_name FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY request_date, request_id) rn FROM {request}) WHERE rn = 1""",
)
def d15(t):
    rows = t.request.select("person_id", "request_date", "request_id", "field_name")
    return rs.first_per_key(rows, "person_id", ["request_date", "request_id"]).select("person_id", "request_id", "field_name")


@query(
    "d16_rollup_parent",
    """SELECT COALESCE(o.parent_id, o.org_id) AS top_id, count(*) AS n_records, count(DISTINCT p.org_id) AS n_orgs FROM {person} p JOIN {org} o ON o.org_id = p.org_id GROUP BY 1""",
)
def d16(t):
    return rs.rollup_parent(t.person, t.org)
