"""Bindings: statistics and the sectioned directory."""

from rosterloom.operators import stats as st
from rosterloom.operators.rank import resolve_heads

from .bind_rank import HEADS_SQL
from .bind_search import VERSIONS
from .tables import query

_STATUS = ", ".join(f"count_if(status = '{s}') AS {st._name(s)}" for s in st.STATUSES)


@query("l1_status_by_org", f"SELECT org_id, count(*) AS n_total, {_STATUS}, CAST(0 AS BIGINT) AS n_unknown FROM {{person}} GROUP BY 1")
def l1(t):
    return st.status_by_org(t.person)


_REL = {"people": "person", "places": "place", "heads": "head"}


@query(
    "l2_org_stats",
    "SELECT o.org_id, o.org_name, "
    + ", ".join(f"(SELECT count(*) FROM {{{v}}} x WHERE x.org_id = o.org_id) AS n_{k}" for k, v in _REL.items())
    + """, (SELECT count(*) FROM {org} x WHERE x.parent_id = o.org_id) AS n_children, (SELECT count(*) FROM {request} r JOIN {person} p ON p.person_id = r.person_id WHERE p.org_id = o.org_id) AS n_requests FROM {org} o""",
)
def l2(t):
    relations = {k: (getattr(t, v), "org_id") for k, v in _REL.items()}
    relations["children"] = (t.org, "parent_id")
    relations["requests"] = (t.request.join(t.person.select("person_id", "org_id"), "person_id"), "org_id")
    return st.org_stats(t.org, relations)


@query("l3_by_category", "SELECT COALESCE(category, '(none)') AS category, count(*) AS n_rows FROM {place} GROUP BY 1")
def l3(t):
    return st.by_category(t.place, "category")


@query(
    "l4_category_tree",
    """WITH u AS (SELECT COALESCE(nullif(trim(category), ''), '(none)') AS category, COALESCE(nullif(trim(station), ''), '(none)') AS subcategory, count(*) AS n FROM {place} GROUP BY 1, 2),
            l AS (SELECT DISTINCT category, station AS subcategory FROM {place} WHERE category IN ('Switchyard', 'Hotline') AND price < 1000 UNION SELECT 'Hotline', 'Brand#99'),
            j AS (SELECT COALESCE(u.category, l.category) AS category, COALESCE(u.subcategory, l.subcategory) AS subcategory, COALESCE(n, 0) AS n, l.category IS NOT NULL AS is_listed FROM u FULL JOIN l ON u.category = l.category AND u.subcategory = l.subcategory)
       SELECT category, subcategory, CAST(sum(n) AS BIGINT) AS n_rows, count_if(NOT is_listed) AS n_unlisted, CAST(grouping(category) * 2 + grouping(subcategory) AS BIGINT) AS level FROM j GROUP BY ROLLUP (category, subcategory)""",
)
def l4(t):
    listed = t.place.where("category IN ('Switchyard', 'Hotline') AND price < 1000").select("category", "station")
    listed = listed.union(t.spark.sql("SELECT 'Hotline', 'Brand#99'"))
    return st.category_tree(t.place, "category", "station", listed)


@query(
    "l5_totals",
    """SELECT 'people' AS figure, count(*) AS value FROM {person} UNION ALL SELECT 'active people', count(*) FROM {person} WHERE status = 'ACTIVE' UNION ALL SELECT 'organizations', count(*) FROM {org}
       UNION ALL SELECT 'places', count(*) FROM {place} UNION ALL SELECT 'pending requests', count(*) FROM {request} WHERE status = 'PENDING'""",
)
def l5(t):
    return st.totals(
        {
            "people": t.person, "active people": t.person.where("status = 'ACTIVE'"), "organizations": t.org,
            "places": t.place, "pending requests": t.request.where("status = 'PENDING'"),
        }
    )


@query(
    "l6_version_stats",
    f"""SELECT count(*) AS n_versions, (SELECT version_number FROM ({VERSIONS}) ORDER BY generated_on DESC, version_id DESC LIMIT 1) AS latest_version, count_if(status = 'PUBLISHED') AS n_published FROM ({VERSIONS})""",
)
def l6(t):
    return st.version_stats(t.spark.sql(VERSIONS, orders=t.orders))


DIRECTORY_SQL = f"""SELECT COALESCE(o.org_name, 'Unknown') AS org_name, 1 AS section_no, 'people' AS section, CASE WHEN h.person_id IS NOT NULL THEN 0 ELSE 1 END AS rank, p.person_name AS name, p.person_id AS record_id, p.mobile AS phone, p.email
    FROM {{person}} p LEFT JOIN {{org}} o ON o.org_id = p.org_id LEFT JOIN ({HEADS_SQL}) h ON h.person_id = p.person_id WHERE p.status = 'ACTIVE'
    UNION ALL SELECT COALESCE(o.org_name, 'Unknown'), CASE WHEN contains(lower(p.category), 'switchyard') THEN 3 WHEN contains(lower(p.category), 'control room') THEN 2 ELSE 4 END,
      CASE WHEN contains(lower(p.category), 'switchyard') THEN 'switchyards' WHEN contains(lower(p.category), 'control room') THEN 'control rooms' ELSE 'other' END, 0, p.label, p.place_id, p.phone, p.email
    FROM {{place}} p LEFT JOIN {{org}} o ON o.org_id = p.org_id"""


@query("l7_directory_rows", f"SELECT * FROM ({DIRECTORY_SQL})")
def l7(t):
    rows = st.directory_rows(t.org, t.person, t.place, resolve_heads(t.person, t.org))
    return rows.orderBy(*st.DIRECTORY_ORDER)
