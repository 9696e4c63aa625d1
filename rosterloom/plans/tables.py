"""Given tables and the registry views derived from them.

Each view is one SQL text that Spark and DuckDB both accept, so a query and its
oracle start from the same rows; what the operator does is written separately on
each side.  ``{name}`` stands for another table or view.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # two-level organization tree: regions are parents (ids from 1000), nations children
    "org": """
        SELECT CAST(n_nationkey AS BIGINT) AS org_id, n_name AS org_name,
               CAST(1000 + n_regionkey AS BIGINT) AS parent_id,
               CASE WHEN n_nationkey > 20 THEN 'Utility' WHEN n_nationkey > 8 THEN 'Generator' ELSE 'Transmission' END AS category,
               CASE WHEN n_regionkey < 2 THEN 'North' WHEN n_regionkey < 4 THEN 'South' ELSE '' END AS state,
               n_nationkey IN (3, 4) AS head_excluded
        FROM {nation}
        UNION ALL
        SELECT CAST(1000 + r_regionkey AS BIGINT), r_name, CAST(NULL AS BIGINT), 'Region', '', FALSE FROM {region}
    """,
    "person": """
        SELECT CAST(c_custkey AS BIGINT) AS person_id, c_name AS person_name,
               CAST(c_nationkey AS BIGINT) AS org_id,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Chief Engineer'
                    WHEN 'BUILDING' THEN 'Additional Chief Engineer (Civil)'
                    WHEN 'FURNITURE' THEN 'Sr. Manager'
                    WHEN 'HOUSEHOLD' THEN 'General Manager' ELSE 'Liaison' END AS title,
               CASE WHEN c_acctbal < 0 THEN 'RETIRED' WHEN c_acctbal < 300 THEN 'TRANSFERRED'
                    WHEN c_acctbal < 600 THEN 'ON LEAVE' ELSE 'ACTIVE' END AS status,
               c_acctbal > 9700 AS flagged, c_acctbal BETWEEN 5000 AND 5400 AS is_kmp,
               CASE WHEN c_acctbal < 100 THEN '' WHEN c_acctbal < 500 THEN NULL
                    ELSE '+91 98' || lpad(CAST(c_custkey AS STRING), 8, '0') END AS mobile,
               CASE WHEN c_acctbal < 700 THEN NULL ELSE '022-' || CAST(2000000 + c_custkey AS STRING) END AS office,
               CASE WHEN c_acctbal BETWEEN 0 AND 200 THEN '' WHEN c_acctbal BETWEEN 200 AND 400 THEN NULL
                    WHEN c_acctbal BETWEEN 400 AND 500 THEN c_name
                    WHEN c_acctbal > 9000 THEN 'Desk' || CAST(c_nationkey AS STRING) || '@Example.org'
                    ELSE replace(c_name, '#', '.') || '@' || c_mktsegment || '.Example.org' END AS email,
               c_mktsegment AS dept, c_acctbal AS balance
        FROM {customer}
    """,
    # place contacts: control rooms, switchyards and others
    "place": """
        SELECT CAST(p_partkey AS BIGINT) AS place_id, p_name AS label,
               CASE p_type WHEN 'ECONOMY' THEN 'Control Room' WHEN 'PROMO' THEN 'Switchyard'
                    WHEN 'LARGE' THEN 'Switch Yard' WHEN 'SMALL' THEN 'Hotline' WHEN 'MEDIUM' THEN 'Control Room Backup'
                    ELSE NULL END AS category,
               p_brand AS station,
               CAST(p_size % 27 AS BIGINT) AS org_id,
               '0' || CAST(2200000000 + p_partkey * 7 AS STRING) || ' / ' || CAST(40000 + p_size AS STRING) ||
                   CASE WHEN p_size < 10 THEN ' / ' || CAST(40000 + p_size AS STRING) ELSE '' END AS phone,
               CASE WHEN p_size > 45 THEN NULL ELSE replace(p_name, ' ', '.') || '@' || lower(p_type) || '.example.org' END AS email,
               CASE WHEN p_size < 5 THEN CAST(p_size AS STRING) || '.' || CAST(p_partkey % 3 AS STRING) || ' ' || p_name
                    WHEN p_size < 9 THEN 'M/s ' || p_name WHEN p_size < 13 THEN upper(p_name) ELSE p_name END AS raw_label,
               p_retailprice AS price
        FROM {part}
    """,
    # role holders, some linked to a person
    "head": """
        SELECT CAST(s_suppkey AS BIGINT) AS head_id, CAST(s_nationkey AS BIGINT) AS org_id,
               CASE WHEN s_acctbal < 3000 THEN 'Nodal Officer' ELSE 'Managing Director' END AS role_title,
               CASE WHEN s_acctbal < 6000 THEN CAST(s_suppkey * 3 AS BIGINT) END AS person_id,
               CASE WHEN s_acctbal > 9500 THEN NULL ELSE s_name END AS name,
               CASE WHEN s_acctbal > 9500 THEN NULL ELSE replace(s_name, '#', '_') || '@heads.example.org' END AS email,
               '022' || CAST(30000000 + s_suppkey AS STRING) AS mobile,
               CASE WHEN s_acctbal < 0 THEN 'VACANT' WHEN s_acctbal < 800 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status,
               CASE WHEN s_acctbal < 4000 THEN 'KMP' ELSE 'ADMINISTRATIVE_HEAD' END AS role_category
        FROM {supplier}
    """,
    # assistants of role holders: one per (supplier, linenumber) pair in use
    "assistant": """
        SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS head_id, CAST(l_linenumber AS BIGINT) AS seat,
               'Assistant ' || CAST(l_linenumber AS STRING) || '-' || CAST(l_suppkey AS STRING) AS name,
               'pa' || CAST(l_linenumber AS STRING) || '.' || CAST(l_suppkey AS STRING) || '@heads.example.org' AS email
        FROM {lineitem}
    """,
    # reconciliation sources over people: A is the document, B the store
    "src_a": """
        SELECT person_id, CASE WHEN person_id % 13 <> 0 THEN org_id END AS org_id, lower(person_name) AS person_name, title, mobile, email FROM {person}
        WHERE dept <> 'FURNITURE'
    """,
    "src_b": """
        SELECT person_id,
               CASE WHEN person_id % 13 = 0 THEN NULL WHEN balance BETWEEN 7000 AND 7400 THEN (org_id + 1) % 25 ELSE org_id END AS org_id,
               CASE WHEN balance BETWEEN 5000 AND 5500 THEN upper(person_name) ELSE person_name END AS person_name,
               CASE WHEN balance BETWEEN 1000 AND 2000 THEN 'Manager' ELSE title END AS title,
               CASE WHEN balance BETWEEN 2000 AND 2500 THEN NULL
                    WHEN balance BETWEEN 2500 AND 3000 THEN '0' || CAST(9700000000 + person_id AS STRING)
                    WHEN balance BETWEEN 3000 AND 3300 THEN replace(mobile, '+91 ', '0')
                    ELSE mobile END AS mobile,
               CASE WHEN balance BETWEEN 3000 AND 4000 THEN upper(email)
                    WHEN balance BETWEEN 4000 AND 4500 THEN ''
                    WHEN balance BETWEEN 4500 AND 4700 THEN 'x' || email || ', old' || email ELSE email END AS email
        FROM {person} WHERE balance >= 0
        UNION ALL
        SELECT person_id + 100000000, CASE WHEN person_id % 13 <> 0 THEN org_id END, person_name, CASE WHEN balance < 6150 THEN title ELSE 'Advisor' END, mobile, email
        FROM {person} WHERE balance BETWEEN 6000 AND 6300
    """,
    # findings of a presence comparison by station
    "finding": """
        SELECT CAST(p_partkey AS BIGINT) AS finding_id, p_brand AS station,
               CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'LARGE') THEN 'Missing' ELSE 'Extra' END AS issue,
               CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'Control Room' WHEN p_type IN ('PROMO', 'SMALL') THEN 'Switchyard' ELSE 'Employee' END AS category,
               CASE WHEN p_size < 4 THEN 'Control Room' WHEN p_size = 4 THEN p_brand
                    WHEN p_type IN ('ECONOMY', 'PROMO', 'LARGE') THEN replace(p_name, ' ', ' - ') ELSE upper(p_name) END AS name
        FROM {part}
    """,
    # append-only logs
    "audit": """
        SELECT CAST(event_id AS BIGINT) AS event_id, ts, CAST(user_id AS BIGINT) AS user_id, event_type AS action, value, props
        FROM {events}
    """,
    "request": """
        SELECT CAST(o_orderkey AS BIGINT) AS request_id, CAST(o_custkey AS BIGINT) AS person_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Mobile No.' WHEN '2-HIGH' THEN 'email' WHEN '3-MEDIUM' THEN 'Designation'
                    WHEN '4-NOT SPECIFIED' THEN 'address' END AS field_name,
               CASE WHEN o_orderpriority <> '5-LOW' THEN 'v' || CAST(o_orderkey AS STRING) END AS new_value,
               CASE WHEN o_orderpriority = '5-LOW' THEN 'legacy' || CAST(o_orderkey AS STRING) END AS requested_title,
               CASE o_orderstatus WHEN 'O' THEN 'APPROVED' WHEN 'F' THEN 'PENDING' ELSE 'REJECTED' END AS status,
               o_orderdate AS request_date
        FROM {orders}
    """,
    # ordered document blocks
    "block": """
        SELECT CAST(conv_id AS BIGINT) AS doc_id, CAST(turn AS BIGINT) AS block_no,
               CASE role WHEN 'user' THEN 'heading' WHEN 'system' THEN 'section' ELSE 'paragraph' END AS kind, text
        FROM {conversations}
    """,
}

_NAME = re.compile(r"\{([a-z_]+)\}")


def sql_text(text: str) -> str:
    """Replace every view placeholder by a subquery; base tables keep their name."""

    def expand(m: re.Match) -> str:
        name = m.group(1)
        return f"({sql_text(VIEWS[name])})" if name in VIEWS else name if name in BASE else m.group(0)

    return _NAME.sub(expand, text)


class Tables:
    """Attribute access to the tables of one directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.path}/{name}.parquet")
        if name in VIEWS:
            needs = set(_NAME.findall(VIEWS[name]))
            return self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in needs})
        raise AttributeError(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` and, where SQL can say it, its twin."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if oracle is not None:
            ORACLES[name] = sql_text(oracle).strip()
        return fn

    return add


# Longest-matching-blocks ratio of pairs (a_name, b_name), as CTEs of a recursive WITH: the longest common run of an open
# segment, the first in a_name, then in b_name, and what lies left and right of it.
RATIOS_SQL = """seg(a_name, b_name, al, ah, bl, bh, got) AS (
      SELECT a_name, b_name, CAST(0 AS BIGINT), length(a_name), CAST(0 AS BIGINT), length(b_name), CAST(0 AS BIGINT) FROM pairs
      UNION ALL
      SELECT a_name, b_name, CASE side WHEN 0 THEN al ELSE i + n END, CASE side WHEN 0 THEN i ELSE ah END,
             CASE side WHEN 0 THEN bl ELSE j + n END, CASE side WHEN 0 THEN j ELSE bh END, CASE side WHEN 0 THEN n ELSE 0 END
      FROM (SELECT *, bl + instr(substr(b_name, bl + 1, bh - bl), substr(a_name, i + 1, n)) - 1 AS j
            FROM (SELECT *, n * 1000 - k AS i FROM (SELECT *, (k + 999) // 1000 AS n FROM (
              SELECT a_name, b_name, al, ah, bl, bh, max(size * 1000 - start) AS k FROM (
                SELECT seg.*, start, size FROM seg, unnest(range(al, ah)) s(start), unnest(range(1, ah - start + 1)) z(size)
                WHERE contains(substr(b_name, bl + 1, bh - bl), substr(a_name, start + 1, size))) GROUP BY ALL)))), (VALUES (0), (1)) sides(side)),
    ratios AS (SELECT a_name, b_name, CAST(2 * sum(got) AS DOUBLE) / (length(a_name) + length(b_name)) AS ratio FROM seg GROUP BY a_name, b_name)"""
