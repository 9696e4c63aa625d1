"""Bindings: standardization jobs."""

from pyspark.sql import functions as F

from rosterloom.functions import text as tx
from rosterloom.operators import standardize as st
from rosterloom.session import run_dir
from rosterloom.sources.roster import split_lines

from .tables import query

WS = r"[\s\x{00A0}\x{200B}\x{FEFF}]+"
CLEAN = f"trim(regexp_replace(%s, '{WS}', ' ', 'g'))"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"


@query(
    "b1_clean_text",
    f"""SELECT doc_id, md5({CLEAN % 'text'}) AS text_md5, {CLEAN % 'text'} <> text AS is_changed FROM documents""",
)
def b1(t):
    done = st.clean_text(t.documents.select("doc_id", "text"), "doc_id", ["text"])
    return done.marked.select("doc_id", F.md5("text").alias("text_md5"), (F.size("changed") > 0).alias("is_changed"))


@query(
    "b1_landed",
    f"""WITH c AS (SELECT doc_id, text, {CLEAN % 'text'} AS new FROM documents), n AS (SELECT count(*) AS n_rows, count_if(new <> text) AS n_changes FROM c)
        SELECT 'rows' AS kind, doc_id, md5(new) AS new_md5, NULL AS old_md5, n_rows, n_changes FROM c, n
        UNION ALL SELECT 'log', doc_id, md5(new), md5(text), n_rows, n_changes FROM c, n WHERE new <> text""",
)
def b1_landed(t):
    done = st.land(st.clean_text(t.documents.select("doc_id", "text"), "doc_id", ["text"]), "doc_id", run_dir(t.spark, "cleaned"))
    rows = done.rows.select(F.lit("rows").alias("kind"), "doc_id", F.md5("text").alias("new_md5"), F.lit(None).cast("string").alias("old_md5"))
    log = done.log.select(F.lit("log").alias("kind"), "doc_id", F.md5("new_value").alias("new_md5"), F.md5("old_value").alias("old_md5"))
    n = done.counts.head()
    return rows.unionByName(log).withColumns({"n_rows": F.lit(n.n_rows), "n_changes": F.lit(n.n_changes)})


KEY_IN = "'Dr. ' || raw_label || ' & Sons, ' || station"


@query(
    "b2_match_key",
    f"""WITH k AS (SELECT place_id, regexp_replace(lower({KEY_IN}), '\\bsons\\b', 'son', 'g') AS k FROM {{place}})
        SELECT place_id, trim(regexp_replace(k, '[^a-z0-9]+', ' ', 'g')) AS key_words, regexp_replace(k, '[^a-z0-9]+', '', 'g') AS key_compact,
               regexp_replace(k, '[^a-z]+', '', 'g') AS key_letters,
               trim(regexp_replace(regexp_replace(replace(k, '&', ' and '), '\\b(shri|smt|mr|mrs|ms|dr)\\b\\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key_person
        FROM k""",
)
def b2(t):
    named = t.place.select("place_id", F.expr(KEY_IN).alias("name"))
    return st.match_keys(named, "name", {"sons": "son"}).drop("name")


@query(
    "b3_strip_prefix",
    r"""WITH s AS (SELECT place_id, raw_label, trim(regexp_replace(raw_label, '^[0-9]+(\.[0-9]+)*\.?\s*', '')) AS x FROM {place}),
             d AS (SELECT place_id, raw_label, CASE WHEN starts_with(lower(x), 'm/s small ') THEN trim(substr(x, 11))
                          WHEN starts_with(lower(x), 'm/s ') THEN trim(substr(x, 5)) ELSE x END AS label FROM s)
        SELECT place_id, raw_label AS old_value, label AS new_value FROM d WHERE raw_label <> label""",
)
def b3(t):
    places = t.place.select("place_id", "raw_label")
    return st.strip_prefix(places, "place_id", "raw_label", ["M/s ", "M/s small "]).log.select(
        "place_id", "old_value", "new_value"
    )


@query(
    "b4_phone_set",
    """SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]{5,}'))), ',') AS phones FROM documents
       WHERE regexp_matches(text, '[0-9]{5,}')""",
)
def b4(t):
    docs = t.documents.select("doc_id", tx.phone_set(F.col("text")).alias("p"))
    return docs.where(F.size("p") > 0).select("doc_id", F.array_join("p", ",").alias("phones"))


@query(
    "b5_email_set",
    f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '{EMAIL}'))), ',') AS emails FROM documents
        WHERE regexp_matches(text, '{EMAIL}')""",
)
def b5(t):
    docs = t.documents.select("doc_id", tx.email_set(F.col("text")).alias("e"))
    return docs.where(F.size("e") > 0).select("doc_id", F.array_join("e", ",").alias("emails"))


PHONE_IN = """CASE o_orderpriority WHEN '1-URGENT' THEN '+91 98' || CAST(10000000 + o_orderkey AS STRING)
    WHEN '2-HIGH' THEN '0' || CAST(9810000000 + o_orderkey AS STRING) WHEN '3-MEDIUM' THEN '98' || CAST(10000000 + o_orderkey AS STRING)
    WHEN '4-NOT SPECIFIED' THEN 'ext ' || CAST(o_custkey AS STRING) ELSE CASE WHEN o_orderstatus = 'F' THEN '' ELSE '0091-9' || CAST(910000000 + o_orderkey AS STRING) END END"""


@query(
    "b6_canonical_phone",
    f"""WITH p AS (SELECT o_orderkey, {PHONE_IN} AS phone FROM orders), d AS (SELECT *, regexp_replace(phone, '[^0-9]+', '', 'g') AS d FROM p),
         n AS (SELECT *, CASE WHEN length(d) = 12 AND starts_with(d, '91') THEN substr(d, 3) WHEN length(d) = 11 AND starts_with(d, '0') THEN substr(d, 2)
                WHEN length(d) = 10 THEN d END AS strict, regexp_replace(d, '^0+', '') AS z FROM d),
         m AS (SELECT *, CASE WHEN length(z) > 10 AND starts_with(z, '91') THEN substr(z, 3) ELSE z END AS z2 FROM n)
        SELECT o_orderkey, strict AS national, CASE WHEN trim(phone) = '' THEN 'blank' WHEN strict IS NULL THEN 'review' ELSE 'ok' END AS phone_status,
               nullif(CASE WHEN length(z2) > 10 THEN right(z2, 10) ELSE z2 END, '') AS lenient FROM m""",
)
def b6(t):
    numbers = t.orders.selectExpr("o_orderkey", f"{PHONE_IN} AS phone")
    return (
        st.canonical_phone(numbers, "phone")
        .withColumn("lenient", tx.national_number(F.col("phone"), "lenient"))
        .drop("phone")
    )


@query(
    "b7_split_phones",
    rf"""WITH v AS (SELECT doc_id, regexp_replace(regexp_replace({CLEAN % 'text'}, '{EMAIL}', ' ', 'g'), '(?i)\b(Extension|Extn?)\b\.?\s*', 'Extn. ', 'g') AS v FROM documents),
         parts AS (SELECT doc_id, unnest(regexp_split_to_array(v, '(?i)\bFax(?:\s*No\.?)?\s*:?')) AS part, unnest(range(len(regexp_split_to_array(v, '(?i)\bFax(?:\s*No\.?)?\s*:?')))) AS part_no FROM v),
         toks AS (SELECT doc_id, part_no, unnest(regexp_split_to_array(part, '(?i)\s*(?:,|;|\bor\b|/)\s*')) AS tok, unnest(range(len(regexp_split_to_array(part, '(?i)\s*(?:,|;|\bor\b|/)\s*')))) AS token_no FROM parts),
         n AS (SELECT doc_id, part_no, token_no, CASE WHEN part_no > 0 THEN 'fax' ELSE 'office' END AS phone_type, regexp_replace({CLEAN % 'tok'}, '^[ .;,-]+|[ .;,-]+$', '', 'g') AS number FROM toks)
        SELECT doc_id, phone_type, number, part_no, token_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, phone_type, number ORDER BY part_no, token_no) rn FROM n
          WHERE regexp_matches(number, '[0-9]')) WHERE rn = 1""",
)
def b7(t):
    found = st.split_phones(t.documents, "doc_id", "text", "office")
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("part_no", "token_no")})


@query(
    "b8_dedupe_segments",
    """SELECT place_id, phone AS old_value, split_part(phone, ' / ', 1) || CASE WHEN split_part(phone, ' / ', 2) <> split_part(phone, ' / ', 1) THEN ' / ' || split_part(phone, ' / ', 2) ELSE '' END AS new_value
       FROM {place} WHERE len(string_split(phone, ' / ')) > 2""",
)
def b8(t):
    return st.dedupe_segments(t.place.select("place_id", "phone"), "place_id", "phone").log.select(
        "place_id", "old_value", "new_value"
    )


@query(
    "b9_classify_cells",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM documents), c AS (SELECT DISTINCT doc_id, {CLEAN % 'line'} AS v FROM l)
        SELECT d.doc_id, count_if(regexp_matches(v, '{EMAIL}')) AS n_emails, count_if(NOT regexp_matches(v, '{EMAIL}') AND regexp_matches(v, '[0-9]{{5,}}')) AS n_phones,
               count_if(NOT regexp_matches(v, '{EMAIL}') AND NOT regexp_matches(v, '[0-9]{{5,}}')) AS n_others
        FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id AND v <> '' GROUP BY d.doc_id""".replace("n_others\n", "n_others\n").replace(
        "count_if(NOT regexp_matches(v, '" + EMAIL + "') AND NOT", "count_if(v IS NOT NULL AND NOT regexp_matches(v, '" + EMAIL + "') AND NOT"
    ),
)
def b9(t):
    rows = t.documents.select("doc_id", F.split("text", "\r?\n").alias("cells"))
    sizes = [F.size(c).cast("bigint").alias(f"n_{c}") for c in ("emails", "phones", "others")]
    return st.classify_cells(rows, "cells").select("doc_id", *sizes)


# what the words of the labels below have to become, stated apart from the operator's lists
_AB, _ABS = "'GIS', 'SLDC', 'MW'", "'RLDCS'"
_WORDS = "'chief', 'deputy', 'head', 'general', 'grid', 'and', 'red', 'new', 'old'"
LABEL_IN = """CASE WHEN p_size < 10 THEN upper(p_name) || ' 400-KV GIS' WHEN p_size < 20 THEN 'sldc-' || p_name || '  2ND rldcs'
    WHEN p_size < 30 THEN 'S/S ' || upper(p_type) || ' ' || p_brand WHEN p_size < 34 THEN 'CHIEF ENGINEER AGM' WHEN p_size < 38 THEN 'DEPUTY HEAD (CIVIL) AND CEO' WHEN p_size < 42 THEN 'GENERAL MANAGER - GRID' ELSE p_name || ' 66kv O&M (mw)' END"""


@query(
    "b10_normalize_labels",
    rf"""WITH s AS (SELECT p_partkey, {LABEL_IN} AS label FROM part),
         h AS (SELECT p_partkey, label, trim(regexp_replace(regexp_replace(regexp_replace(label, '(?i)([0-9]+)\s*-?\s*kv\b', '\1 kV', 'g'), '(\w)-(\w)', '\1 \2', 'g'), '\s+', ' ', 'g')) AS x FROM s),
         w AS (SELECT p_partkey, label, list_transform(regexp_extract_all(x, '(?i:[0-9]+(?:st|nd|rd|th)\b)|[A-Za-z]+|[^A-Za-z]'), lambda w:
           CASE WHEN NOT regexp_matches(w, '[A-Za-z]') THEN w WHEN regexp_matches(w, '(?i)^[0-9]+(st|nd|rd|th)$') THEN lower(w)
                WHEN upper(w) IN ({_AB}) THEN upper(w) WHEN lower(w) = 'kv' THEN 'kV' WHEN upper(w) IN ({_ABS}) THEN left(upper(w), length(w) - 1) || 's'
                WHEN lower(w) IN ({_WORDS}) THEN upper(left(w, 1)) || lower(substr(w, 2)) WHEN w = upper(w) AND length(w) <= 6 THEN w
                ELSE upper(left(w, 1)) || lower(substr(w, 2)) END) AS ws FROM h)
        SELECT p_partkey, label AS old_value, array_to_string(ws, '') AS new_value FROM w WHERE label <> array_to_string(ws, '')""",
)
def b10(t):
    labels = t.part.selectExpr("p_partkey", f"{LABEL_IN} AS label")
    return st.normalize_labels(labels, "p_partkey", designations=["label"]).log.select(
        "p_partkey", "old_value", "new_value"
    )


@query(
    "b11_normalize_emails",
    """SELECT person_id, email AS old_value, lower(trim(email)) AS new_value, CASE WHEN trim(email) <> email THEN 'Whitespace' ELSE 'Email lower case' END AS reason
       FROM (SELECT person_id, CASE WHEN dept = 'BUILDING' THEN email || ' ' ELSE email END AS email FROM {person}) WHERE lower(trim(email)) <> email""",
)
def b11(t):
    mails = t.person.selectExpr("person_id", "CASE WHEN dept = 'BUILDING' THEN email || ' ' ELSE email END AS email")
    return st.normalize_emails(mails, "person_id", ["email"]).log.select("person_id", "old_value", "new_value", "reason")


@query(
    "b12_repair_text",
    r"""WITH r AS (SELECT doc_id, text, regexp_replace(regexp_replace(translate(replace(text, chr(65533), ''), '‐‑‒–—−', '------'),
            '\b([A-Z])\s+([A-Z]{2,})\b', '\1\2', 'g'), '\b([A-Z])\s+([a-z])', '\1\2', 'g') AS fixed FROM documents)
        SELECT doc_id, md5(fixed) AS text_md5, fixed <> text AS is_changed FROM r""",
)
def b12(t):
    done = st.repair_text(t.documents.select("doc_id", "text"), "doc_id", ["text"])
    return done.marked.select("doc_id", F.md5("text").alias("text_md5"), (F.size("changed") > 0).alias("is_changed"))


HEADER_RULES = (("name", ("the", "der")), ("phone", ("in",)), ("email", ("on",)), ("address", ("an",)))


@query(
    "b13_map_headers",
    """WITH h AS (SELECT item_id, unnest(string_split(text, ',')) AS header, unnest(range(len(string_split(text, ',')))) AS col_no FROM benchmark),
       f AS (SELECT item_id, CAST(col_no AS BIGINT) AS col_no, header, CASE WHEN contains(lower(header), 'the') OR contains(lower(header), 'der') THEN 'name'
             WHEN contains(lower(header), 'in') THEN 'phone' WHEN contains(lower(header), 'on') THEN 'email' WHEN contains(lower(header), 'an') THEN 'address' END AS field FROM h)
       SELECT item_id, col_no, header, field, field IS NOT NULL AND col_no = min(col_no) OVER (PARTITION BY item_id, field) AS is_mapped FROM f""",
)
def b13(t):
    headers = t.benchmark.select("item_id", F.posexplode(F.split("text", ",")).alias("col_no", "header"))
    headers = headers.withColumn("col_no", F.col("col_no").cast("bigint"))
    return st.map_headers(headers, "item_id", "col_no", "header", HEADER_RULES).select(
        "item_id", "col_no", "header", "field", "is_mapped"
    )


PICK_A = "CASE WHEN p_size < 10 THEN '' WHEN p_size < 20 THEN 'Control Room' ELSE p_name END"
PICK_B = "CASE WHEN p_size % 2 = 0 THEN 'control room' ELSE p_brand END"


@query(
    "b14_pick_label",
    f"""WITH x AS (SELECT p_partkey, {PICK_A} AS a, {PICK_B} AS b FROM part)
        SELECT p_partkey, CASE WHEN lower(b) IN ('control room') AND lower(a) NOT IN ('control room') AND a <> '' THEN a
          WHEN lower(a) IN ('control room') AND lower(b) NOT IN ('control room') AND b <> '' THEN b WHEN a = '' THEN b ELSE a END AS label FROM x""",
)
def b14(t):
    cells = t.part.selectExpr("p_partkey", f"{PICK_A} AS a", f"{PICK_B} AS b")
    return st.pick_label(cells, "a", "b", ["control room"]).select("p_partkey", "label")


IDENTITY_SQL = """SELECT h.head_id, h.org_id, h.status, h.role_title, h.role_category, h.person_id, p.status AS person_status,
    CASE WHEN h.person_id IS NOT NULL THEN p.person_name ELSE h.name END AS name,
    CASE WHEN h.person_id IS NOT NULL THEN p.title ELSE h.role_title END AS title,
    CASE WHEN h.person_id IS NOT NULL THEN p.email ELSE h.email END AS email,
    CASE WHEN h.person_id IS NOT NULL THEN p.mobile ELSE h.mobile END AS mobile
    FROM {head} h LEFT JOIN {person} p ON p.person_id = h.person_id"""


@query("b15_resolve_identity", f"SELECT head_id, name, title, email, mobile FROM ({IDENTITY_SQL})")
def b15(t):
    return st.resolve_identity(t.head, t.person).select("head_id", "name", "title", "email", "mobile")


CONTACTS_SQL = f"""
    SELECT org_id, 'person' AS record_type, person_id AS record_id, COALESCE(person_name, '') AS name, COALESCE(title, '') AS title, COALESCE(email, '') AS email, COALESCE(mobile, '') AS mobile FROM {{person}}
    UNION ALL SELECT org_id, 'role', head_id, COALESCE(name, ''), COALESCE(title, ''), COALESCE(email, ''), COALESCE(mobile, '') FROM ({IDENTITY_SQL})
    UNION ALL SELECT org_id, 'place', place_id, COALESCE(label, ''), COALESCE(category, label, ''), COALESCE(email, ''), COALESCE(phone, '') FROM {{place}}"""


@query("b15_contact_rows", CONTACTS_SQL)
def b15_rows(t):
    return st.to_contact_rows(t.person, st.resolve_identity(t.head, t.person), t.place)


AGENT = """CASE action WHEN 'click' THEN 'Mozilla/5.0 (Windows NT 10.0; Win64) Chrome/' || CAST(CAST(90 + user_id % 30 AS BIGINT) AS STRING) || '.0 Safari/537.36'
    WHEN 'view' THEN CASE WHEN value > 20 THEN 'Mozilla/5.0 (X11; Linux x86_64) Firefox/115.0' ELSE 'Mozilla/5.0 (iPhone; CPU iPhone OS 16_1 like Mac OS X) Version/16.1 Safari/604.1' END
    WHEN 'error' THEN 'Mozilla/5.0 (Windows NT 6.1) Chrome/99.0 Edg/99.0' WHEN 'signup' THEN 'curl/8.0' ELSE NULL END"""


def _case(pairs, col):
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}') THEN '{n}'" for n, p in pairs) + " END"


@query(
    "b16_client_breakdown",
    f"""SELECT {_case(st.BROWSERS, 'agent')} AS browser, {_case(st.SYSTEMS, 'agent')} AS system, count(*) AS n_changes
        FROM (SELECT {AGENT} AS agent FROM {{audit}}) GROUP BY 1, 2""",
)
def b16(t):
    return st.client_breakdown(t.audit.selectExpr(f"{AGENT} AS agent"), "agent")


@query(
    "b17_row_kind",
    r"""WITH x AS (SELECT place_id, lower(concat_ws(' ', raw_label, category, CASE WHEN station = 'Brand#7' THEN '400 kV' END)) AS s FROM {place})
        SELECT place_id, CASE WHEN contains(s, 'switchyard') OR contains(s, 'switch yard') THEN 'switchyard'
          WHEN contains(s, 'control room') OR contains(s, 'control  room') OR contains(s, 'controlroom') OR contains(s, 'hotline') OR contains(s, 'power house') THEN 'control_room'
          WHEN regexp_matches(s, '\b(s/s|cr|pss|ais|gis)\b|[0-9]+\s*kv\b') THEN 'facility' ELSE 'person' END AS kind FROM x""",
)
def b17(t):
    rows = t.place.selectExpr("place_id", "raw_label", "category", "CASE WHEN station = 'Brand#7' THEN '400 kV' END AS unit")
    return st.row_kind(rows, ["raw_label", "category", "unit"]).select("place_id", "kind")
