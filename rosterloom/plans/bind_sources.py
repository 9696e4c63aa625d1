"""Bindings: sources, sinks and loads."""

from pyspark.sql import functions as F

from rosterloom.functions.text import is_blank
from rosterloom.session import run_dir
from rosterloom.sources import commit, roster, sinks

from .tables import query

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query(
    "a1_read_roster",
    """SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey IS NOT NULL AND trim(c_name) <> ''""",
)
def a1(t):
    sheet = roster.read_roster(t.spark, f"{t.path}/customer.parquet", CUSTOMER, "c_custkey", "c_name")
    return sheet.select("c_custkey", "c_name", "c_mktsegment")


CONTACT_COLS = [
    "o_orderkey AS contact_id",
    "CASE o_orderstatus WHEN 'O' THEN 'person' WHEN 'F' THEN 'head' ELSE 'place' END AS ref_type",
    "o_custkey AS ref_id",
    "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Mobile' ELSE 'Office' END AS contact_type",
    "CASE WHEN o_totalprice < 20000 THEN ' ' ELSE CAST(9000000000 + o_orderkey AS STRING) END AS value",
]


@query(
    "a2_attach_contacts",
    f"""WITH c AS (SELECT {', '.join(CONTACT_COLS)} FROM orders),
             own AS (SELECT * FROM c WHERE ref_type = 'person' AND trim(value) <> '')
        SELECT p.person_id, p.person_name, own.contact_type, own.value,
               CASE WHEN own.ref_id IS NOT NULL THEN row_number() OVER (PARTITION BY own.ref_id, own.contact_type ORDER BY own.contact_id) END AS position
        FROM {{person}} p LEFT JOIN own ON own.ref_id = p.person_id""",
)
def a2(t):
    people = t.person.select("person_id", "person_name")
    contacts = t.orders.selectExpr(*CONTACT_COLS)
    return roster.attach_contacts(people, "person_id", contacts, "person").select(
        "person_id", "person_name", "contact_type", "position", "value"
    )


@query(
    "a3_read_blocks",
    """SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS block_no, kind AS block_kind, line AS text
       FROM (SELECT conv_id, turn, role AS kind, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line,
                    unnest(range(len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))))) AS pos FROM conversations)""",
)
def a3(t):
    """Flatten turns to line blocks, land them as a block table, and scan it."""
    from rosterloom.functions.skew import carry

    turns = t.conversations.withColumn("key", F.struct("conv_id", "turn", "role"))
    lines = roster.split_lines(turns, "key", "text").select(
        "key.conv_id", "key.turn", F.col("key.role").alias("block_kind"), "line_no", "line"
    )
    blocks = carry(lines, ["conv_id"], ["turn", "line_no"], number="block_no")
    path = run_dir(t.spark, "blocks")
    blocks.selectExpr(
        "conv_id AS doc_id", "block_no", "block_kind", "CAST(NULL AS INT) AS heading_level", "CAST(NULL AS INT) AS table_no",
        "CAST(line_no AS INT) AS row_no", "line AS text", "array(line) AS cells",
    ).write.parquet(path)
    return roster.read_blocks(t.spark, path).select("doc_id", "block_no", "block_kind", "text")


REPORT_SQL = "SELECT finding_id, station, issue, name FROM {finding}"


@query("a4_write_report", REPORT_SQL)
def a4(t):
    path = run_dir(t.spark, "report")
    found = t.finding.select("finding_id", "station", "issue", "name")
    sinks.write_report(found, path, ["station", "issue", "name", "finding_id"], "csv", by="issue")
    schema = "finding_id bigint, station string, name string, issue string"
    return roster.read_table(t.spark, path, schema, "csv", header=True).select("finding_id", "station", "issue", "name")


@query(
    "a5_write_sections",
    """SELECT 'people' AS section, person_id AS record_id, person_name AS name FROM {person}
       UNION ALL SELECT 'places', place_id, label FROM {place} UNION ALL SELECT 'heads', head_id, role_title FROM {head}""",
)
def a5(t):
    path = run_dir(t.spark, "sections")
    sinks.write_sections(
        {
            "people": t.person.selectExpr("person_id AS record_id", "person_name AS name"),
            "places": t.place.selectExpr("place_id AS record_id", "label AS name"),
            "heads": t.head.selectExpr("head_id AS record_id", "role_title AS name"),
        },
        path,
    )
    return t.spark.read.parquet(path).select("section", "record_id", "name")


@query(
    "a6_table_scan",
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderstatus = 'F'",
)
def a6(t):
    stored = roster.read_table(t.spark, f"{t.path}/orders.parquet")
    return stored.where("o_orderkey >= 100 AND o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    "a7_replace_load",
    """SELECT person_id, person_name, dept FROM {person} WHERE dept <> 'BUILDING'
       UNION ALL SELECT person_id + 500000000, upper(person_name), 'BUILDING' FROM {person} WHERE dept = 'HOUSEHOLD'""",
)
def a7(t):
    stored = t.person.select("person_id", "person_name", "dept")
    new = t.person.where("dept = 'HOUSEHOLD'").selectExpr(
        "person_id + 500000000 AS person_id", "upper(person_name) AS person_name", "'BUILDING' AS dept"
    )
    return sinks.replace_load(stored, new, F.col("dept") == "BUILDING")


@query(
    "a7_replace_partitions",
    """SELECT person_id, person_name, dept FROM {person} WHERE dept <> 'BUILDING'
       UNION ALL SELECT person_id + 500000000, upper(person_name), 'BUILDING' FROM {person} WHERE dept = 'HOUSEHOLD'""",
)
def a7_partitions(t):
    """The same replacement on a stored table, touching one owner's files only."""
    path = run_dir(t.spark, "owners")
    t.person.select("person_id", "person_name", "dept").write.partitionBy("dept").parquet(path)
    new = t.person.where("dept = 'HOUSEHOLD'").selectExpr(
        "person_id + 500000000 AS person_id", "upper(person_name) AS person_name", "'BUILDING' AS dept"
    )
    sinks.replace_partitions(new, path, "dept")
    return t.spark.read.parquet(path)


@query(
    "a8_run_record",
    """SELECT 'people' AS run_name, count_if(b.person_id IS NULL) AS inserted,
              count_if(b.person_id IS NOT NULL AND (a.title IS DISTINCT FROM b.title OR a.email IS DISTINCT FROM b.email)) AS updated,
              count_if(b.person_id IS NOT NULL AND NOT (a.title IS DISTINCT FROM b.title OR a.email IS DISTINCT FROM b.email)) AS skipped, 'APPLIED' AS status
       FROM {src_a} a LEFT JOIN {src_b} b ON a.person_id = b.person_id""",
)
def a8(t):
    return sinks.run_record(t.src_b, t.src_a, "person_id", ["title", "email"], "people")


@query(
    "a8_run_table",
    """SELECT 'people' AS run_name, count_if(b.person_id IS NULL) AS inserted,
              count_if(b.person_id IS NOT NULL AND (a.title IS DISTINCT FROM b.title OR a.email IS DISTINCT FROM b.email)) AS updated,
              count_if(b.person_id IS NOT NULL AND NOT (a.title IS DISTINCT FROM b.title OR a.email IS DISTINCT FROM b.email)) AS skipped, 'APPLIED' AS status
       FROM {src_a} a LEFT JOIN {src_b} b ON a.person_id = b.person_id
       UNION ALL SELECT 'people again', 0, 0, count(*), 'NO CHANGE' FROM {src_a}""",
)
def a8_table(t):
    path = run_dir(t.spark, "runs")
    sinks.record_run(sinks.run_record(t.src_b, t.src_a, "person_id", ["title", "email"], "people"), path)
    sinks.record_run(sinks.run_record(t.src_a, t.src_a, "person_id", ["title", "email"], "people again"), path)
    return t.spark.read.parquet(path)


OWNED = "person_id bigint, person_name string, dept string, title string, email string"


def _committed(t):
    """Two loads with one commit each: everybody, then the people of two departments anew."""
    path = run_dir(t.spark, "committed")
    cols = ["person_id", "person_name", "dept", "title", "email"]
    commit.replace_owners(t.person.select(*cols), path, "dept", sinks.run_record(t.person.where("false"), t.person, "person_id", ["title", "email"], "people"))
    new = t.person.where("dept IN ('BUILDING', 'HOUSEHOLD')").select(*cols).withColumn("title", F.upper("title"))
    commit.replace_owners(new, path, "dept", sinks.run_record(t.person, new, "person_id", ["title", "email"], "people again"))
    return path


@query("a7_commit", "SELECT person_id, person_name, dept, CASE WHEN dept IN ('BUILDING', 'HOUSEHOLD') THEN upper(title) ELSE title END AS title, email FROM {person}")
def a7_commit(t):
    return commit.read_owners(t.spark, _committed(t), OWNED)


@query(
    "a8_committed_runs",
    """SELECT CAST(1 AS BIGINT) AS number, 'people' AS run_name, count(*) AS inserted, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS skipped, 'APPLIED' AS status FROM {person}
       UNION ALL SELECT 2, 'people again', 0, count_if(title IS DISTINCT FROM upper(title)), count_if(title IS NOT DISTINCT FROM upper(title)), CASE WHEN count_if(title IS DISTINCT FROM upper(title)) > 0 THEN 'APPLIED' ELSE 'NO CHANGE' END
       FROM {person} WHERE dept IN ('BUILDING', 'HOUSEHOLD')""",
)
def a8_committed(t):
    return commit.runs(t.spark, _committed(t))


DIM_SQL = "SELECT min(place_id) AS dim_id, station || ' ' || label AS name FROM {place} WHERE category = 'Switchyard' GROUP BY 2"


@query(
    "a9_upsert_dim",
    f"""WITH d AS ({DIM_SQL}), n AS (SELECT DISTINCT station || ' ' || label AS name FROM {{place}})
        SELECT dim_id, name, FALSE AS is_new FROM d UNION ALL
        SELECT (SELECT max(dim_id) FROM d) + row_number() OVER (ORDER BY name), name, TRUE FROM n WHERE name NOT IN (SELECT name FROM d)""",
)
def a9(t):
    named = t.place.withColumn("name", F.concat_ws(" ", "station", "label"))
    dim = named.where("category = 'Switchyard'").groupBy("name").agg(F.min("place_id").alias("dim_id"))
    return sinks.upsert_dim(dim, named.select("name"), "dim_id", "name")


KEYED = "SELECT category, CASE WHEN place_id % 7 <> 0 THEN label END AS label, CASE WHEN place_id % 11 <> 0 THEN station END AS station, place_id FROM {place}"


@query(
    "a10_insert_new",
    f"""WITH k AS ({KEYED}) SELECT label, station, place_id FROM (SELECT *, row_number() OVER (PARTITION BY label, station ORDER BY place_id) rn FROM k) s
       WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM k p WHERE p.category = 'Hotline' AND p.label IS NOT DISTINCT FROM s.label AND p.station IS NOT DISTINCT FROM s.station)""",
)
def a10(t):
    rows = t.spark.sql(KEYED, place=t.place)
    return sinks.insert_new(rows.where("category = 'Hotline'"), rows.select("label", "station", "place_id"), ["label", "station"], "place_id")


@query(
    "a11_upsert_fill",
    """SELECT COALESCE(h.head_id, s.head_id) AS head_id, CASE WHEN trim(COALESCE(h.name, '')) = '' THEN s.name ELSE h.name END AS name,
              CASE WHEN trim(COALESCE(h.email, '')) = '' THEN s.email ELSE h.email END AS email, COALESCE(s.role_title, h.role_title) AS role_title,
              CASE WHEN h.head_id IS NULL THEN 'inserted' WHEN s.head_id IS NULL THEN 'kept'
                   WHEN (CASE WHEN trim(COALESCE(h.name, '')) = '' THEN s.name ELSE h.name END) IS DISTINCT FROM h.name
                     OR (CASE WHEN trim(COALESCE(h.email, '')) = '' THEN s.email ELSE h.email END) IS DISTINCT FROM h.email
                     OR COALESCE(s.role_title, h.role_title) IS DISTINCT FROM h.role_title THEN 'updated' ELSE 'unchanged' END AS action
       FROM (SELECT * FROM {head} WHERE org_id < 20) h FULL JOIN
            (SELECT head_id, role_title || ' 2' AS x, CASE WHEN status = 'ACTIVE' THEN role_title ELSE 'Director' END AS role_title,
                    'S' || CAST(head_id AS STRING) AS name, 's' || CAST(head_id AS STRING) || '@x.org' AS email FROM {head} WHERE org_id > 2) s
       ON s.head_id = h.head_id""",
)
def a11(t):
    src = t.head.where("org_id > 2").selectExpr(
        "head_id", "CASE WHEN status = 'ACTIVE' THEN role_title ELSE 'Director' END AS role_title",
        "'S' || CAST(head_id AS STRING) AS name", "'s' || CAST(head_id AS STRING) || '@x.org' AS email",
    )
    return sinks.upsert_fill(t.head.where("org_id < 20"), src, "head_id", ["name", "email"], ["role_title"])
