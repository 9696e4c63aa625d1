"""Bindings: keyword search and browsing."""

from pyspark.sql import functions as F

from rosterloom.operators import search as se
from rosterloom.operators.rank import resolve_heads
from rosterloom.operators.standardize import resolve_identity

from .bind_rank import HEADS_SQL
from .bind_standardize import IDENTITY_SQL
from .tables import query


def _any(cols, q):
    return "(" + " OR ".join(f"COALESCE(contains(lower({c}), '{q}'), FALSE)" for c in cols) + ")"


PERSON = ("person_name", "title", "mobile", "office", "dept", "status", "org_name", "state", "parent_name")
LISTING = """(SELECT p.*, o.org_name, o.state, q.org_name AS parent_name FROM {person} p LEFT JOIN {org} o ON o.org_id = p.org_id LEFT JOIN {org} q ON q.org_id = o.parent_id)"""


@query("k1_search_people", f"SELECT person_id, person_name, org_name FROM {LISTING} WHERE {_any(PERSON, 'nation_1')}")
def k1(t):
    return se.search_people(t.person, t.org, "Nation_1").select("person_id", "person_name", "org_name")


@query("k1_search_people_email", f"SELECT person_id, email FROM {LISTING} WHERE {_any([*PERSON, 'email'], '5@building')}")
def k1_email(t):
    return se.search_people(t.person, t.org, "5@Building").select("person_id", "email")


@query(
    "k2_search_places",
    f"""SELECT place_id, label, station FROM {{place}} p WHERE {_any(['label', 'phone', 'station', 'category'], 'north')}
          OR org_id IN (SELECT org_id FROM {{org}} WHERE contains(lower(state), 'north'))""",
)
def k2(t):
    return se.search_places(t.place, t.org, "North").select("place_id", "label", "station")


def _browse(q):
    return f"""WITH m AS (SELECT org_id FROM {{org}} WHERE {_any(['org_name'], q)}), s AS (SELECT org_id FROM m UNION SELECT org_id FROM {{org}} WHERE parent_id IN (SELECT org_id FROM m)),
      p AS (SELECT l.* FROM {LISTING} l WHERE is_kmp AND status = 'ACTIVE' AND (org_id IN (SELECT org_id FROM s) OR {_any(PERSON, q)})),
      shown AS (SELECT org_id, 'person' AS section, person_id AS record_id, person_name AS record_name FROM p),
      pl AS (SELECT org_id, CASE WHEN contains(lower(category), 'control room') THEN 'control_room' WHEN contains(lower(category), 'switchyard') THEN 'switchyard' ELSE 'other' END AS section, place_id, label FROM {{place}}
             WHERE org_id IN (SELECT org_id FROM s) OR {_any(['label', 'phone'], q)}),
      c AS (SELECT * FROM shown UNION ALL SELECT * FROM pl)
      SELECT * FROM c UNION ALL SELECT org_id, 'empty', NULL, NULL FROM {{org}} WHERE parent_id IN (SELECT org_id FROM m) AND org_id NOT IN (SELECT org_id FROM c WHERE section <> 'other')"""


@query("k3_browse_keyword", _browse("nation_2"))
def k3(t):
    return se.browse_keyword(t.org, t.person, t.place, resolve_heads(t.person, t.org), "Nation_2")


@query("k3_browse_keyword_parent", _browse("asia"))
def k3_parent(t):
    people = t.person
    return se.browse_keyword(t.org, people, t.place, resolve_heads(people, t.org), "Asia")


@query(
    "k4_browse_category",
    """SELECT o.org_id, o.org_name, o.state AS subcategory, COALESCE(p.n, 0) AS n_people, p.f AS first_person, COALESCE(k.c, 0) AS n_control_room, COALESCE(k.s, 0) AS n_switchyard, COALESCE(k.x, 0) AS n_other,
         CAST(CASE o.org_name WHEN 'NATION_12' THEN 1 ELSE 2 END AS BIGINT) AS pin
       FROM {org} o LEFT JOIN (SELECT org_id, count(*) AS n, min(person_name) AS f FROM {person} WHERE is_kmp AND status = 'ACTIVE' GROUP BY 1) p ON p.org_id = o.org_id
       LEFT JOIN (SELECT org_id, count_if(COALESCE(contains(lower(category), 'control room'), FALSE)) AS c, count_if(COALESCE(contains(lower(category), 'switchyard') AND NOT contains(lower(category), 'control room'), FALSE)) AS s,
                  count_if(NOT COALESCE(contains(lower(category), 'control room') OR contains(lower(category), 'switchyard'), FALSE)) AS x FROM {place} GROUP BY 1) k ON k.org_id = o.org_id
       WHERE o.category = 'Generator'""",
)
def k4(t):
    return se.browse_category(t.org, t.person, t.place, "Generator", ["NATION_12"])


@query(
    "k5_category_cards",
    """SELECT o.category, count(*) AS n_organizations, CAST(sum(COALESCE(n, 0)) AS BIGINT) AS n_contacts FROM {org} o LEFT JOIN (SELECT org_id, count(*) AS n FROM {person} WHERE is_kmp AND status = 'ACTIVE' GROUP BY 1) p ON p.org_id = o.org_id GROUP BY 1""",
)
def k5(t):
    return se.category_cards(t.org, t.person)


@query("k6_facets", "SELECT DISTINCT station, category FROM {place} WHERE trim(COALESCE(category, '')) <> ''")
def k6(t):
    return se.facets(t.place, "station", "category")


@query(
    "k7_search_roles",
    f"""SELECT head_id, name, role_title FROM ({IDENTITY_SQL}) x WHERE role_category = 'ADMINISTRATIVE_HEAD' AND (person_id IS NULL OR person_status = 'ACTIVE') AND status = 'ACTIVE' AND contains(lower(role_title), 'director')
          AND org_id IN (SELECT org_id FROM {{org}} WHERE category = 'Generator') AND ({_any(['name', 'role_title'], 't 7-')} OR EXISTS (SELECT 1 FROM {{assistant}} a WHERE a.head_id = x.head_id AND contains(lower(a.name), 't 7-')))""",
)
def k7(t):
    heads = resolve_identity(t.head, t.person)
    return se.search_roles(heads, t.assistant, t.org, q="T 7-", title="Director", category="Generator", status="ACTIVE").select(
        "head_id", "name", "role_title"
    )


VERSIONS = """SELECT CAST(o_orderkey AS BIGINT) AS version_id, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month,
    CAST(year(o_orderdate) AS STRING) || '.' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS version_number, CASE o_orderstatus WHEN 'O' THEN 'PUBLISHED' WHEN 'F' THEN 'DRAFT' ELSE 'ARCHIVED' END AS status,
    CAST(CAST(o_orderdate AS DATE) AS STRING) AS generated_on FROM {orders}"""


@query(
    "k8_search_versions",
    f"SELECT version_id, version_number, status, generated_on FROM ({VERSIONS}) WHERE year = 1997 AND month = 5 AND contains(lower(status), 'pub')",
)
def k8(t):
    versions = t.spark.sql(VERSIONS, orders=t.orders)
    return se.search_versions(versions, 5, 1997, "Pub").select("version_id", "version_number", "status", "generated_on")


TOKENS = r"SELECT doc_id, unnest(regexp_split_to_array(lower(text || ' ' || source), '[^\p{L}\p{N}]+')) AS token FROM documents"


@query("k9_token_index", f"SELECT token, doc_id, count(*) AS hits FROM ({TOKENS}) WHERE token <> '' GROUP BY 1, 2")
def k9_index(t):
    return se.token_index(t.documents, "doc_id", ["text", "source"])


@query(
    "k9_search_tokens",
    f"""SELECT doc_id, count(DISTINCT token) AS n_words, count(*) AS n_hits FROM ({TOKENS}) WHERE token IN ('the', 'and', 'src4') GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20""",
)
def k9_search(t):
    index = se.token_index(t.documents, "doc_id", ["text", "source"])
    return se.search_tokens(index, "doc_id", ["The", "and", "src4"], n=20)


@query("k9_search_text", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license') OR contains(lower(lang), 'license') ORDER BY doc_id LIMIT 20")
def k9_text(t):
    return se.search_text(t.documents, "doc_id", ["text", "source", "lang"], "License", n=20).select("doc_id", "source")


TERMS = "SELECT DISTINCT split_part(text, '.', 1) AS term FROM {benchmark} UNION SELECT DISTINCT text FROM {benchmark} UNION SELECT DISTINCT split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) FROM {benchmark}"


@query("k10_search_batch", f"WITH s AS ({TERMS}) SELECT doc_id, term FROM documents JOIN (SELECT term FROM s WHERE term <> '') ON contains(lower(text), lower(term))")
def k10(t):
    terms = t.spark.sql(TERMS, benchmark=t.benchmark)
    return se.search_batch(t.documents, "doc_id", "text", terms, "term")
