"""Bindings: classification and category maintenance."""

from pyspark.sql import functions as F

from rosterloom.functions.rules import Rule
from rosterloom.operators import classify as cl

from .tables import query

RULES = [
    Rule("Priority", "in_vip", equals=(True,)),
    Rule("Hot", "label", contains=("hot",), unless=("ring",)),
    Rule("Yard", "category", equals=("Switchyard", "Switch Yard")),
    Rule("Metal", "label", regex=r"(?i)\b(rod|bolt|plate)\b", review=True),
]


@query(
    "h1_classify",
    """SELECT place_id, CASE WHEN vip THEN 'Priority' WHEN contains(lower(label), 'hot') AND NOT contains(lower(label), 'ring') THEN 'Hot' WHEN category IN ('Switchyard', 'Switch Yard') THEN 'Yard' WHEN regexp_matches(lower(label), '\\b(rod|bolt|plate)\\b') THEN 'Metal' ELSE 'Others' END AS new_class,
         NOT vip AND NOT (contains(lower(label), 'hot') AND NOT contains(lower(label), 'ring')) AND NOT COALESCE(category IN ('Switchyard', 'Switch Yard'), FALSE) AS needs_review
       FROM (SELECT *, place_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R') AS vip FROM {place})""",
)
def h1(t):
    vip = t.lineitem.where("l_quantity >= 50 AND l_returnflag = 'R'").selectExpr("l_partkey AS place_id")
    return cl.classify(t.place, "place_id", RULES, "Others", {"vip": vip}).select("place_id", "new_class", "needs_review")


KEYWORDS = [Rule("Thermal", "t", contains=("hot", "red")), Rule("Hydel", "t", regex=r"(?i)\b(blue|bolt)\b"), Rule("Thermal", "t", contains=("economy",))]


@query(
    "h2_keyword_class",
    """WITH x AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS s FROM part), y AS (SELECT p_partkey, contains(s, 'hot') OR contains(s, 'red') OR contains(s, 'economy') AS th, regexp_matches(s, '\\b(blue|bolt)\\b') AS hy FROM x)
       SELECT p_partkey, CASE WHEN th AND NOT hy THEN 'Thermal' WHEN hy AND NOT th THEN 'Hydel' END AS keyword_class, CAST(th AS BIGINT) + CAST(hy AS BIGINT) AS n_classes FROM y""",
)
def h2(t):
    rows = t.part.selectExpr("p_partkey", "p_name || ' ' || p_type AS t")
    return cl.keyword_class(rows, KEYWORDS).drop("t")


@query(
    "h3_apply_mapping",
    """SELECT org_id, category AS old_value, CASE WHEN org_id < 6 THEN 'Transmission' WHEN org_id < 1000 AND state = 'South' THEN 'Utility' ELSE 'Others' END AS new_value FROM {org}
       WHERE category <> CASE WHEN org_id < 6 THEN 'Transmission' WHEN org_id < 1000 AND state = 'South' THEN 'Utility' ELSE 'Others' END""",
)
def h3(t):
    mapping = t.org.where("org_id < 6 OR (org_id < 1000 AND state = 'South')").selectExpr("org_id", "CASE WHEN org_id < 6 THEN 'Transmission' ELSE 'Utility' END AS new_value")
    return cl.apply_mapping(t.org, mapping, "org_id", "category", "Others")


SECTIONS = "SELECT CAST(p_partkey % 1000 AS BIGINT) AS place_id, CASE WHEN p_size > 35 THEN p_type END AS section FROM {part}"
MAPPING = "SELECT DISTINCT p_type AS section, CASE p_type WHEN 'ECONOMY' THEN 'Control Room' WHEN 'PROMO' THEN 'Switchyard' WHEN 'SMALL' THEN 'Control Room' END AS implied FROM {part} WHERE p_type <> 'LARGE'"


@query(
    "h4_section_check",
    f"""WITH s AS (SELECT place_id, count(DISTINCT section) AS n, min(section) AS section FROM ({SECTIONS}) WHERE section IS NOT NULL GROUP BY 1)
        SELECT p.place_id, p.category, CASE WHEN s.n = 1 THEN s.section END AS section, CASE WHEN s.n = 1 THEN m.implied END AS implied,
          CASE WHEN s.n IS NULL THEN 'none' WHEN s.n > 1 THEN 'several' WHEN s.section = 'STANDARD' THEN 'ambiguous' WHEN m.implied IS NULL THEN 'unmapped' WHEN m.implied = p.category THEN 'match' ELSE 'mismatch' END AS bucket
        FROM {{place}} p LEFT JOIN s ON s.place_id = p.place_id LEFT JOIN ({MAPPING}) m ON m.section = s.section""",
)
def h4(t):
    sections = t.spark.sql(SECTIONS, part=t.part).where("section IS NOT NULL")
    return cl.section_check(t.place, "place_id", "category", sections, t.spark.sql(MAPPING, part=t.part), ["STANDARD"])


@query(
    "h5_propose_class",
    """WITH x AS (SELECT place_id, COALESCE(category, '(none)') AS cur, contains(lower(raw_label || ' ' || station), 'red') AS r, contains(lower(raw_label || ' ' || station), 'ring') AS g FROM {place}),
            y AS (SELECT place_id, cur, CASE WHEN r AND g THEN 'both keywords' WHEN r AND cur NOT IN ('Red Group', '(none)') THEN 'overrides existing' WHEN g AND cur NOT IN ('Switchyard', '(none)') THEN 'overrides existing' END AS flag, r, g FROM x),
            z AS (SELECT *, CASE WHEN flag IS NOT NULL THEN NULL WHEN r THEN 'Red Group' WHEN g THEN 'Switchyard' WHEN cur = 'Switch Yard' THEN 'Switchyard' WHEN cur = 'Hotline' THEN 'Control Room' END AS prop FROM y)
       SELECT place_id, cur AS current_class, prop AS proposed_class, flag FROM z WHERE flag IS NOT NULL OR (prop IS NOT NULL AND prop <> cur)""",
)
def h5(t):
    rows = t.place.withColumn("text", F.concat_ws(" ", "raw_label", "station"))
    return cl.propose_class(
        rows, "place_id", "text", "category", {"red": "Red Group", "ring": "Switchyard"},
        {"Switch Yard": "Switchyard", "Hotline": "Control Room"}, "(none)",
    )


@query(
    "h6_propose_membership",
    """WITH c AS (SELECT DISTINCT l_partkey AS place_id FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 1), x AS (SELECT p.*, c.place_id IS NOT NULL AS ok FROM {place} p LEFT JOIN c ON c.place_id = p.place_id),
            y AS (SELECT *, CASE WHEN ok THEN 'override' WHEN category IN ('Hotline') THEN 'excluded by design' WHEN contains(lower(label), 'plate') THEN 'confirm' WHEN contains(lower(label), 'bolt') THEN 'ambiguous' ELSE 'needs review' END AS status
                  FROM x WHERE ok OR contains(lower(label), 'red') OR contains(lower(label), 'old'))
       SELECT place_id, label, category, CASE WHEN status IN ('override', 'confirm') THEN 'CPSU' WHEN status = 'ambiguous' THEN 'CPSU?' END AS proposed_class, status FROM y""",
)
def h6(t):
    confirmed = t.lineitem.where("l_quantity = 50 AND l_linenumber = 1").selectExpr("l_partkey AS place_id")
    return cl.propose_membership(t.place, "place_id", "label", "category", "CPSU", ["red", "old"], confirmed, ["Hotline"], ["plate"], ["bolt"])


@query(
    "h7_merge_class",
    """SELECT place_id, CASE WHEN category IN ('Switch Yard', 'Hotline') THEN 'Switchyard' ELSE category END AS category, CASE WHEN category IN ('Switch Yard', 'Hotline') THEN category ELSE station END AS station FROM {place}""",
)
def h7(t):
    return cl.merge_class(t.place.select("place_id", "category", "station"), "category", "station", {"Switch Yard": "Switchyard", "Hotline": "Switchyard"})


@query(
    "h7_droppable",
    """WITH m AS (SELECT CASE WHEN category IN ('Switch Yard', 'Hotline') THEN 'Switchyard' ELSE category END AS category FROM {place} UNION ALL SELECT 'Hotline' FROM orders WHERE o_orderstatus = 'P')
       SELECT c.category, count(m.category) AS n_references, count(m.category) = 0 AS can_drop FROM (SELECT DISTINCT category FROM {place} WHERE category IS NOT NULL) c LEFT JOIN m ON m.category = c.category GROUP BY 1""",
)
def h7_drop(t):
    merged = cl.merge_class(t.place, "category", "station", {"Switch Yard": "Switchyard", "Hotline": "Switchyard"})
    rules = t.orders.where("o_orderstatus = 'P'").select(F.lit("Hotline").alias("category"))
    classes = t.place.select("category").where("category IS NOT NULL").distinct()
    return cl.droppable(classes, "category", [(merged, "category"), (rules, "category")])


@query(
    "h8_impact",
    """SELECT o.org_id, 'people' AS kind, (SELECT count(*) FROM {person} p WHERE p.org_id = o.org_id) AS n_dependents FROM {org} o UNION ALL SELECT o.org_id, 'places', (SELECT count(*) FROM {place} p WHERE p.org_id = o.org_id) FROM {org} o
       UNION ALL SELECT o.org_id, 'heads', (SELECT count(*) FROM {head} p WHERE p.org_id = o.org_id) FROM {org} o UNION ALL SELECT o.org_id, 'children', (SELECT count(*) FROM {org} p WHERE p.parent_id = o.org_id) FROM {org} o""",
)
def h8(t):
    kinds = {"people": (t.person, "org_id"), "places": (t.place, "org_id"), "heads": (t.head, "org_id"), "children": (t.org, "parent_id")}
    return cl.impact(t.org.select("org_id"), "org_id", kinds)


@query(
    "h9_sync_pairs",
    """WITH u AS (SELECT DISTINCT station, label FROM {place} WHERE category IS NOT NULL), l AS (SELECT DISTINCT station, label FROM {place} WHERE org_id < 20)
       SELECT station, label, 'add' AS action FROM (SELECT * FROM u EXCEPT SELECT * FROM l) UNION ALL SELECT station, label, 'remove' FROM (SELECT * FROM l EXCEPT SELECT * FROM u)""",
)
def h9(t):
    used = t.place.where("category IS NOT NULL")
    return cl.sync_pairs(used, t.place.where("org_id < 20").select("station", "label"), ["station", "label"])


HOLDERS = "SELECT s_suppkey, 'The nation-' || CAST(s_nationkey AS STRING) AS org_name, CASE WHEN s_nationkey % 5 < 2 THEN 'North' ELSE '' END AS state FROM {supplier}"


@query(
    "h10_derive_attr",
    f"""SELECT s_suppkey, h.state AS old_value, l.state AS new_value FROM ({HOLDERS}) h JOIN (SELECT 'the ' || replace(lower(org_name), '_', ' ') AS k, min(state) AS state FROM {{org}} GROUP BY 1) l ON l.k = trim(regexp_replace(lower(h.org_name), '[^a-z0-9]+', ' ', 'g')) WHERE h.state <> l.state AND l.state <> ''""",
)
def h10(t):
    lookup = t.org.selectExpr("'THE ' || org_name AS org_name", "state")
    return cl.derive_attr(t.spark.sql(HOLDERS, supplier=t.supplier), "s_suppkey", "org_name", "state", lookup, "org_name", "state")
