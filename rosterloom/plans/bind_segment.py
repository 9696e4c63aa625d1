"""Bindings: ordered-block segmentation."""

from pyspark.sql import functions as F

from rosterloom.functions import text as tx
from rosterloom.operators import segment as sg
from rosterloom.sources.roster import split_lines

from .tables import query



@query(
    "c1_fill_heading",
    """SELECT doc_id, block_no, md5(last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no)) AS heading_md5 FROM {block}""",
)
def c1(t):
    return sg.fill_heading(t.block, "doc_id", "block_no", F.col("kind") == "heading", "text").select(
        "doc_id", "block_no", F.md5("heading").alias("heading_md5")
    )


# table rows derived from turns; eight conversations make one document
ROWS = """SELECT CAST(floor(conv_id / 8) AS BIGINT) AS doc_id, CAST(conv_id * 100 + turn AS BIGINT) AS row_no, text,
    CASE WHEN role = 'system' THEN '3.1. Site_' || CAST(length(text) % 40 AS STRING) || '|'
         WHEN role = 'user' AND length(text) % 3 = 0 THEN 'Nation_' || CAST(length(text) % 40 AS STRING) || '|Nation_' || CAST(length(text) % 40 AS STRING) || '|'
         WHEN role = 'user' AND length(text) % 3 = 1 THEN 'Name|Designation|Mobile' WHEN role = 'user' THEN 'Quote|Quote'
         WHEN length(text) % 9 = 0 THEN '||' ELSE 'Person ' || CAST(turn AS STRING) || '|Engineer|98' || CAST(10000000 + conv_id AS STRING) END AS row_text
    FROM {conversations}"""

MARKED = f"""SELECT *, row_kind IN ('title', 'banner') AS is_break, CASE WHEN row_kind IN ('title', 'banner') THEN trim(regexp_replace(c1, '^[0-9]+(\\.[0-9]+)*\\.?\\s*', '')) END AS section_title FROM (
  SELECT *, CASE WHEN c1 = '' THEN 'blank' WHEN regexp_matches(c1, '^[0-9]+(\\.[0-9]+)*\\.\\s*[A-Za-z]') THEN 'title'
    WHEN banner AND (h1 OR h2) AND EXISTS (SELECT 1 FROM nation WHERE contains(lower(c1), lower(n_name)) OR contains(lower(n_name), lower(c1))) THEN 'banner'
    WHEN banner THEN 'noise_banner' WHEN header THEN 'header' ELSE 'data' END AS row_kind FROM (
    SELECT *, COALESCE(lead(header, 1) OVER w, FALSE) AS h1, COALESCE(lead(header, 2) OVER w, FALSE) AS h2 FROM (
      SELECT doc_id, row_no, text, row_text, split_part(row_text, '|', 1) AS c1, row_text = 'Name|Designation|Mobile' AS header,
             starts_with(row_text, 'Nation') OR row_text = 'Quote|Quote' AS banner FROM ({ROWS})) WINDOW w AS (PARTITION BY doc_id ORDER BY row_no)))"""


def _marked(t):
    rows = t.spark.sql(ROWS, conversations=t.conversations).withColumn("cells", F.split("row_text", r"\|"))
    return sg.mark_sections(rows, "doc_id", "row_no", "cells", t.nation, "n_name")


@query("c2_mark_sections", f"SELECT doc_id, row_no, row_kind, is_break, section_title FROM ({MARKED})")
def c2(t):
    return _marked(t).select("doc_id", "row_no", "row_kind", "is_break", "section_title")


SEGMENTED = f"""SELECT *, sum(CAST(is_break AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY row_no) AS segment_no,
    last_value(section_title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row_no) AS segment_title FROM ({MARKED})"""


@query(
    "c3_segments",
    f"""SELECT doc_id, CAST(segment_no AS BIGINT) AS segment_no, max(segment_title) AS segment_title, count_if(row_kind = 'data') AS n_rows FROM ({SEGMENTED}) GROUP BY 1, 2""",
)
def c3(t):
    return sg.segment_sizes(sg.segments(_marked(t), "doc_id", "row_no"), "doc_id")


@query(
    "c4_drop_noise",
    r"""SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line,
          unnest(range(1, 1 + len(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))))) AS line_no FROM documents)
        WHERE trim(regexp_replace(line, '[\s\x{00A0}\x{200B}\x{FEFF}]+', ' ', 'g')) <> '' AND NOT regexp_matches(trim(regexp_replace(line, '[\s\x{00A0}\x{200B}\x{FEFF}]+', ' ', 'g')), '^[\s\-_=*.#~|]+$')
          AND NOT contains(lower(line), 'click here') AND NOT contains(lower(line), 'license') AND lower(trim(regexp_replace(line, '[\s\x{00A0}\x{200B}\x{FEFF}]+', ' ', 'g'))) NOT IN ('name', 'the.')""",
)
def c4(t):
    lines = split_lines(t.documents, "doc_id", "text")
    return sg.drop_noise(lines, "line", ["click here", "license"], ["name", "the."])


@query(
    "c5_fill_levels",
    """SELECT doc_id, block_no, md5(last_value(CASE WHEN kind = 'section' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no)) AS section_md5,
              md5(last_value(CASE WHEN kind IN ('section', 'heading') THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no)) AS heading_md5 FROM {block}""",
)
def c5(t):
    levels = sg.fill_levels(
        t.block, "doc_id", "block_no", F.col("kind") == "section", F.col("kind") == "heading", "text"
    )
    return levels.select("doc_id", "block_no", F.md5("section").alias("section_md5"), F.md5("heading").alias("heading_md5"))


@query(
    "c6_capture_paragraph",
    f"""WITH s AS ({SEGMENTED}), c AS (SELECT doc_id, segment_no, min(CASE WHEN row_kind = 'header' THEN row_no END) AS tbl,
          min(CASE WHEN row_kind <> 'header' AND NOT is_break AND (regexp_matches(text, '\\b[0-9]{{6}}\\b') OR regexp_matches(trim(text), '^[0-9][0-9\\s]{{4,9}}$')
               OR regexp_matches(lower(text), '\\b(main|of|the)\\s*[-–]\\s*[0-9]{{3}}') OR (regexp_matches(lower(text), '\\b(main|of|the)\\s*[,.]?\\s*$') AND NOT regexp_matches(text, '\\b[A-Z]{{3,}}\\b'))
               OR contains(lower(text), 'p.o.') OR contains(lower(text), 'p.o ') OR contains(lower(text), 'dist.') OR contains(lower(text), 'dist:') OR contains(lower(text), ' dist ')
               OR contains(lower(text), 'pin :') OR contains(lower(text), 'pin code') OR contains(lower(text), 'village') OR contains(lower(text), 'sector') OR contains(lower(text), 'floor')
               OR contains(lower(text), 'ph no') OR contains(lower(text), 'fax no') OR contains(lower(text), 'email:') OR contains(lower(text), 'opp ') OR contains(lower(text), 'near ')
               OR contains(lower(text), 'plot no') OR contains(lower(text), 'substation compound') OR contains(lower(text), 'road no') OR contains(lower(text), 'road,') OR contains(lower(text), 'nagar,')
               OR contains(lower(text), 'nagar.') OR contains(lower(text), 'pincode') OR contains(lower(text), 'mob:') OR contains(lower(text), 'mob :') OR contains(lower(text), 'po:')
               OR contains(lower(text), 'po :') OR contains(lower(text), 'p.o:')) THEN row_no END) AS cand FROM s GROUP BY 1, 2)
        SELECT c.doc_id, CAST(c.segment_no AS BIGINT) AS segment_no, md5(CASE WHEN tbl IS NULL OR cand < tbl THEN s.text END) AS address_md5 FROM c LEFT JOIN s ON s.doc_id = c.doc_id AND s.row_no = c.cand""",
)
def c6(t):
    rows = sg.segments(_marked(t), "doc_id", "row_no")
    found = sg.capture_paragraph(rows, "doc_id", "row_no", "text", F.col("row_kind") == "header", places=["main", "of", "the"])
    return found.select("doc_id", "segment_no", F.md5("address").alias("address_md5"))


@query(
    "c7_merge_by_label",
    """WITH p AS (SELECT place_id, station, lower(label) AS label_key, phone, email FROM {place}), v AS (
         SELECT place_id, station, label_key, 'phones' AS field, unnest(list_distinct(regexp_extract_all(phone, '[0-9]{5,}'))) AS value FROM p
         UNION ALL SELECT place_id, station, label_key, 'emails', lower(email) FROM p WHERE email IS NOT NULL)
       SELECT station, label_key, field, value, min(place_id) AS first_at, count(*) AS n_records FROM v GROUP BY ALL""",
)
def c7(t):
    values = {"phones": tx.phone_set(F.col("phone")), "emails": tx.email_set(F.col("email"))}
    return sg.merge_by_label(t.place, "station", "label", values, "place_id")
