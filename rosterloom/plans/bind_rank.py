"""Bindings: ranking and ordering."""

from pyspark.sql import functions as F

from rosterloom.functions.rules import Tiers
from rosterloom.operators import rank

from .tables import query

_PHRASES = [(i, p) for i, g in enumerate(rank.DEFAULT_TIERS.groups) for p in g]
_TIER_ROWS = ", ".join(f"({i}, '{p}', {n})" for n, (i, p) in enumerate(_PHRASES))
TIER_SQL = f"(SELECT * FROM (VALUES {_TIER_ROWS}) t(tier, phrase, pos))"
RANKED_SQL = f"""
    SELECT p.*, COALESCE(r.tier, {rank.DEFAULT_TIERS.unranked}) AS title_rank, r.phrase AS title_phrase
    FROM {{person}} p LEFT JOIN (
        SELECT d.title, t.tier, t.phrase,
               row_number() OVER (PARTITION BY d.title ORDER BY length(t.phrase) DESC, t.tier, t.pos) AS rn
        FROM (SELECT DISTINCT title FROM {{person}}) d JOIN {TIER_SQL} t
          ON regexp_matches(lower(d.title), '\\b' || t.phrase || '\\b')) r
      ON r.title = p.title AND r.rn = 1"""


HEADS_SQL = f"""
    SELECT org_id, person_id, CAST(title_rank AS BIGINT) AS title_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY flagged DESC,
             CASE WHEN flagged THEN 0 ELSE title_rank END, person_id) AS rn
      FROM ({RANKED_SQL}) WHERE status = 'ACTIVE'
        AND org_id NOT IN (SELECT org_id FROM {{org}} WHERE head_excluded)) WHERE rn = 1"""


@query("i1_rank_titles", f"SELECT person_id, CAST(title_rank AS BIGINT) AS title_rank, title_phrase FROM ({RANKED_SQL})")
def i1(t):
    return rank.rank_titles(t.person, "title").select(
        "person_id", F.col("title_rank").cast("bigint").alias("title_rank"), "title_phrase"
    )


@query(
    "i2_resolve_heads",
    f"""SELECT o.org_id, o.org_name, h.person_id, p.person_name, p.title, h.title_rank
        FROM ({HEADS_SQL}) h JOIN {{org}} o ON o.org_id = h.org_id JOIN {{person}} p ON p.person_id = h.person_id""",
)
def i2(t):
    heads = rank.resolve_heads(t.person, t.org).withColumn("title_rank", F.col("title_rank").cast("bigint"))
    return (
        heads.join(t.org.select("org_id", "org_name"), "org_id")
        .join(t.person.select("person_id", "person_name", "title"), "person_id")
        .select("org_id", "org_name", "person_id", "person_name", "title", "title_rank")
    )


@query(
    "i2_resolve_heads_all_orgs",
    HEADS_SQL.replace("AND org_id NOT IN (SELECT org_id FROM {org} WHERE head_excluded)", ""),
)
def i2_all(t):
    return rank.resolve_heads(t.person, t.org, respect_exclusion=False).withColumn(
        "title_rank", F.col("title_rank").cast("bigint")
    )


SCORES = ((55, ("general manager",)), (45, ("chief engineer",)), (10, ("manager",)))
EXCLUDED = ("additional", "operator")


@query(
    "i3_resolve_heads_scored",
    """SELECT org_id, person_id, CAST(score AS BIGINT) AS score FROM (
         SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY score DESC, person_id) rn FROM (
           SELECT org_id, person_id, CASE WHEN contains(lower(title), 'additional') OR contains(lower(title), 'operator') THEN 0
             WHEN contains(lower(title), 'general manager') THEN 55 WHEN contains(lower(title), 'chief engineer') THEN 45
             WHEN contains(lower(title), 'manager') THEN 10 ELSE 0 END AS score
           FROM {person} WHERE status <> 'RETIRED') WHERE score > 0) WHERE rn = 1""",
)
def i3(t):
    people = t.person.where("status <> 'RETIRED'")
    return rank.resolve_heads_scored(people, SCORES, EXCLUDED).withColumn("score", F.col("score").cast("bigint"))


@query(
    "i4_pinned_order",
    """SELECT org_id, org_name, CAST(CASE org_name WHEN 'NATION_7' THEN 1 WHEN 'ASIA' THEN 2 ELSE 3 END AS BIGINT) AS pin,
              CASE WHEN org_name NOT IN ('NATION_7', 'ASIA') THEN lower(org_name) END AS name_key FROM {org}""",
)
def i4(t):
    pin, name = rank.pinned_order("org_name", ["NATION_7", "ASIA"])
    return t.org.select("org_id", "org_name", pin.cast("bigint").alias("pin"), name.alias("name_key")).orderBy(
        "pin", "name_key"
    )


@query(
    "i5_heads_first",
    f"""SELECT p.person_id, p.person_name, o.org_name, h.person_id IS NOT NULL AS is_head
        FROM {{person}} p JOIN {{org}} o ON o.org_id = p.org_id LEFT JOIN ({HEADS_SQL}) h ON h.person_id = p.person_id
        ORDER BY is_head DESC, org_name, person_name, p.person_id LIMIT 200""",
)
def i5(t):
    people = t.person.join(t.org.select("org_id", "org_name"), "org_id")
    listed = rank.heads_first(people, rank.resolve_heads(t.person, t.org), n=200)
    return listed.select("person_id", "person_name", "org_name", "is_head")


_SUGGEST = (("part", "p_name", "place", 6), ("nation", "n_name", "organization", 4), ("customer", "c_name", "person", 8), ("supplier", "s_name", "role", 8))


@query(
    "i6_suggest",
    "SELECT kind, value, CAST(tier AS BIGINT) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY lower(value) ORDER BY kind_no) rn FROM ("
    + " UNION ALL ".join(
        f"""SELECT * FROM (SELECT {i} AS kind_no, '{kind}' AS kind, CASE WHEN starts_with(lower(value), 'r') THEN 0 ELSE 1 END AS tier, value
            FROM (SELECT DISTINCT trim({col}) AS value FROM {table}) WHERE contains(lower(value), 'r') ORDER BY tier, value LIMIT {cap})"""
        for i, (table, col, kind, cap) in enumerate(_SUGGEST)
    )
    + ")) WHERE rn = 1 ORDER BY kind_no, tier, value LIMIT 10",
)
def i6(t):
    kinds = [(getattr(t, table), col, kind, cap) for table, col, kind, cap in _SUGGEST]
    return rank.suggest(kinds, "R", total=10).withColumn("tier", F.col("tier").cast("bigint"))


@query(
    "i7_top_groups",
    "SELECT org_id, count(*) AS n_rows FROM {person} GROUP BY org_id ORDER BY n_rows DESC, org_id LIMIT 10",
)
def i7(t):
    return rank.top_groups(t.person, "org_id", 10)


@query(
    "i8_numbered",
    "SELECT person_id, org_id, person_name, row_number() OVER (PARTITION BY org_id ORDER BY title, person_name, person_id) AS serial FROM {person}",
)
def i8(t):
    return rank.numbered(t.person, ["org_id"], ["title", "person_name", "person_id"]).select(
        "person_id", "org_id", "person_name", "serial"
    )


@query(
    "i9_page",
    """SELECT request_id, status, CAST((SELECT count(*) FROM {request}) AS BIGINT) AS total_rows FROM {request}
       ORDER BY request_date DESC, request_id LIMIT 25 OFFSET 50""",
)
def i9(t):
    listed = rank.page(t.request, [F.desc("request_date"), "request_id"], 3, 25)
    return listed.select("request_id", "status", "total_rows")
