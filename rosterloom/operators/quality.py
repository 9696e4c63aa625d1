"""Data-quality findings and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterloom.functions import text as tx
from rosterloom.session import durable, run_dir


def completeness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: rows, blanks, coverage %; plus rows where all are blank.  One pass."""
    blank = {c: tx.is_blank(F.col(c).cast("string")) for c in cols}
    every = reduce(lambda a, b: a & b, blank.values())
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(b).alias(f"_{c}") for c, b in blank.items()], F.count_if(every).alias("_all")
    )
    cells = [F.struct(F.lit(c).alias("field"), F.col(f"_{c}").alias("n_blank")) for c in cols]
    cells.append(F.struct(F.lit("(all)").alias("field"), F.col("_all").alias("n_blank")))
    filled = F.col("n_rows") - F.col("n_blank")
    pct = F.when(F.col("n_rows") > 0, F.round(100.0 * filled / F.nullif("n_rows", F.lit(0)), 2))
    return counts.select("n_rows", F.inline(F.array(*cells))).withColumn("coverage_pct", pct)


def childless(parents: DataFrame, children: DataFrame, key: str, flag: Column | None = None) -> DataFrame:
    """Parents without children, and parents with children but none flagged."""
    n = children.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(flag if flag is not None else F.lit(True)).alias("n_flagged")
    )
    j = parents.join(n, key, "left").na.fill(0, ["n_children", "n_flagged"])
    issue = F.when(F.col("n_children") == 0, "no children").when(F.col("n_flagged") == 0, "no flagged child")
    return j.withColumn("issue", issue).where(F.col("issue").isNotNull())


# Signs of text that is not a clean name.
GARBAGE = r"[\x{200B}\x{FFFD}]"
DASH = r"[\x{2013}\x{2014}]"
ADDRESS_HINTS = ("road no", "plot no", "sector ", "flat ", "survey")


def _flags(pairs: Sequence[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(label)) for test, label in pairs]))


def text_flags(df: DataFrame, key: str, col: str, hints: Sequence[str] = ADDRESS_HINTS) -> DataFrame:
    """Suspicious texts with their flags, joined."""
    c = F.col(col)
    flags = _flags([
        (c.contains("  "), "double space"),
        (c != F.trim(c), "edge space"),
        (c.rlike(GARBAGE), "garbage character"),
        (c.rlike(DASH), "unicode dash"),
        (tx.contains_any(c, hints), "address words"),
        (F.lower(c).isin(list(tx.PLACEHOLDERS)), "placeholder"),
    ])
    return df.select(key, F.array_join(flags, ", ").alias("flags")).where("flags <> ''")


def address_signals(df: DataFrame, key: str, col: str, org_hints: Sequence[str], city_hints: Sequence[str]) -> DataFrame:
    """Labels that carry an address: signals, confidence tier, proposed label.

    A place name alone is low confidence.  The label is split only at an explicit
    "Address:" marker.
    """
    c = F.col(col)
    commas = F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))
    signals = _flags([
        (F.lower(c).contains("address:"), "marker"),
        (c.rlike(r"-\s*[0-9]{6}\b"), "postal code"),
        (c.rlike(r"\([^()]{10,}\)"), "long parenthesis"),
        (commas >= 2, "commas"),
        (F.lower(c).contains("backup"), "backup"),
        (tx.contains_any(c, org_hints), "organization text"),
        (tx.contains_any(c, city_hints), "place name"),
        (F.length(c) > 80, "long"),
    ])
    at = F.instr(c, "Address:")
    return (
        df.select(key, signals.alias("_s"), F.when(at > 0, F.trim(F.substr(c, F.lit(1), at - 1))).alias("proposed_label"))
        .where(F.size("_s") > 0)
        .select(
            key, F.array_join("_s", "; ").alias("signals"), F.size("_s").cast("bigint").alias("n_signals"),
            F.when(F.array_join("_s", "") == "place name", "low").otherwise("high").alias("tier"), "proposed_label",
        )
    )


def repeated_segments(df: DataFrame, key: str, col: str) -> DataFrame:
    parts = tx.segments(F.col(col))
    return df.select(key, F.col(col).alias("raw_value"), tx.max_repeat(parts).cast("bigint").alias("max_repeat")).where("max_repeat >= 2")


def no_digit(df: DataFrame, key: str, col: str) -> DataFrame:
    """Non-blank values of a number column without any digit."""
    return df.where(~tx.is_blank(F.col(col)) & ~F.col(col).rlike("[0-9]")).select(key, F.col(col).alias("raw_value"))


def numbered_prefix(df: DataFrame, key: str, group: str, name: str, labels: DataFrame, label: str) -> DataFrame:
    """Names with a leading number, checked against the source's labels of the group.

    Labels are matched by joins, not collected per group.
    """
    full, bare = tx.folded(F.col(name)), F.lower(tx.strip_serial(F.col(name)))
    rows = df.where(tx.strip_serial(F.col(name)) != F.trim(name)).select(key, group, name, full.alias("_full"), bare.alias("_bare"))
    known = labels.select(group, tx.folded(F.col(label)).alias("_l")).distinct()
    hit = lambda on, flag: known.select(group, F.col("_l").alias(on), F.lit(True).alias(flag))
    any_label = known.select(group).distinct().withColumn("_any", F.lit(True))
    j = rows.join(hit("_full", "_f"), [group, "_full"], "left").join(hit("_bare", "_b"), [group, "_bare"], "left").join(any_label, group, "left")
    status = (
        F.when(F.col("_any").isNull(), "no data")
        .when(F.col("_f").isNotNull(), "same in source")
        .when(F.col("_b").isNotNull(), "confirmed")
        .otherwise("unconfirmed")
    )
    return j.select(key, group, name, status.alias("status")).where("status <> 'same in source'")


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    parent_key: str


def _issue(df: DataFrame, check: str, table: str, row: Column, message: Column | str) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return df.select(
        F.lit(check).alias("check_name"), F.lit(table).alias("table_name"), row.cast("string").alias("row_ref"), text.alias("message")
    )


def _row_issues(df: DataFrame, table: str, row: Column, tests: Sequence[tuple[Column, str, Column | str]]) -> DataFrame:
    """All row-level checks of a table in one pass over it."""
    cells = [
        F.when(
            test,
            F.struct(
                F.lit(check).alias("check_name"), F.lit(table).alias("table_name"), row.cast("string").alias("row_ref"),
                (F.lit(message) if isinstance(message, str) else message).alias("message"),
            ),
        )
        for test, check, message in tests
    ]
    return df.select(F.inline(F.array_compact(F.array(*cells))))


def integrity(tables: Mapping[str, tuple[DataFrame, str, str]], fks: Sequence[ForeignKey]) -> DataFrame:
    """Gate over tables given as name -> (rows, id column, name column).

    Every table is read twice: once for its ids and how often each occurs, which are kept for the checks of repeated
    ids and of all references to it, and once for all checks of its rows, in one projection.
    """
    parts, ids = [], {}
    wanted = {(table, key) for table, (_, key, _) in tables.items()} | {(fk.parent, fk.parent_key) for fk in fks}
    for table, column in sorted(wanted):
        rows = tables[table][0].where(F.col(column).isNotNull())
        ids[table, column] = durable(rows.groupBy(F.col(column).alias("_id")).agg(F.count(F.lit(1)).alias("n")))
    for table, (df, key, name) in tables.items():
        repeated = ids[table, key].where("n > 1")
        parts.append(_issue(repeated, "duplicate id", table, F.col("_id"), F.concat(F.col("n").cast("string"), F.lit(" rows"))))
        tests = [
            (F.col(key).isNull(), "missing id", F.coalesce(F.col(name), F.lit(""))),
            (tx.is_blank(F.col(name)), "blank name", "name is blank"),
        ]
        own = [fk for fk in fks if fk.table == table]
        rows = df.select(*dict.fromkeys([key, name, *[fk.column for fk in own]]))
        for i, fk in enumerate(own):
            parent = ids[fk.parent, fk.parent_key].select(F.col("_id").alias(f"_p{i}"))
            rows = rows.join(parent, F.col(fk.column) == F.col(f"_p{i}"), "left")
            missing = F.col(fk.column).isNotNull() & F.col(f"_p{i}").isNull()
            tests.append((missing, "unknown parent", F.concat(F.lit(f"{fk.column}="), F.col(fk.column).cast("string"))))
        parts.append(_row_issues(rows, table, F.col(key), tests))
    return reduce(DataFrame.unionByName, parts)


def hierarchy_check(rows: DataFrame, key: str, child: str, parent: str, tree: DataFrame) -> DataFrame:
    """Rows whose parent differs from their child's real parent, or whose child is unknown."""
    real = tree.select(F.col("org_id").alias(child), F.col("parent_id").alias("_real"), F.lit(True).alias("_known"))
    j = rows.where(F.col(child).isNotNull()).join(real, child, "left")
    issue = F.when(F.col("_known").isNull(), "unknown child").when(~F.col(parent).eqNullSafe(F.col("_real")), "wrong parent")
    return j.withColumn("issue", issue).where(F.col("issue").isNotNull()).select(
        key, child, parent, F.col("_real").alias("real_parent"), "issue"
    )


def gate(issues: DataFrame, severity: Mapping[str, str], keep: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts per check with severity and hidden messages, the first ``keep`` messages per check, one verdict row).

    All three come from one run: the issues are written once, and the verdict is observed on that write.
    """
    spark = issues.sparkSession
    sev = F.lit("WARNING")
    for check, level in severity.items():
        sev = F.when(F.col("check_name") == check, F.lit(level)).otherwise(sev)
    seen, path = Observation(), run_dir(spark, "gate")
    graded = issues.withColumn("severity", sev)
    count = lambda level: F.count_if(F.col("severity") == level)
    graded.observe(seen, count("ERROR").alias("n_errors"), count("WARNING").alias("n_warnings")).write.parquet(path)
    graded = spark.read.schema(graded.schema).parquet(path)
    counts = graded.groupBy("check_name", "severity").agg(F.count(F.lit(1)).alias("n_issues")).select(
        "check_name", "n_issues", "severity", F.greatest(F.col("n_issues") - keep, F.lit(0)).cast("bigint").alias("n_hidden")
    )
    first = W.partitionBy("check_name").orderBy("table_name", "row_ref", "message")
    shown = graded.drop("severity").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= keep)
    found = {n: seen.get.get(n) or 0 for n in ("n_errors", "n_warnings")}
    verdict = spark.createDataFrame([(found["n_errors"], found["n_warnings"], found["n_errors"] == 0)], "n_errors bigint, n_warnings bigint, passed boolean")
    return counts, shown, verdict


LIST_FILTERS = {
    "ORGANIZATION": "org_id", "ORGANIZATION_CATEGORY": "category", "ORGANIZATION_SUBCATEGORY": "subcategory",
    "ROLE": "role", "STATUS": "status", "INCLUDE_EMPLOYEE": "person_id", "EXCLUDE_EMPLOYEE": "person_id",
}


def _bad_email(c: str) -> Column:
    return ~tx.is_blank(F.col(c)) & ~tx.is_email(F.col(c))


def audit_lists(members: DataFrame, rules: DataFrame, people: DataFrame) -> DataFrame:
    """Duplicate members, members without a person, bad emails, malformed rules, empty tables."""
    ref = F.concat_ws("/", F.col("list_id").cast("string"), F.col("person_id").cast("string"))
    dup = members.groupBy("list_id", "person_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    j = members.join(people.select("person_id", "email", F.lit(True).alias("_p")), "person_id", "left")
    values = sorted(set(LIST_FILTERS.values()))
    filled = reduce(lambda a, b: a + b, [F.col(v).isNotNull().cast("int") for v in values])
    expected = reduce(
        lambda acc, kv: F.when(F.col("filter_type") == kv[0], F.col(kv[1]).isNotNull()).otherwise(acc), LIST_FILTERS.items(), F.lit(False)
    )
    parts = [
        _issue(dup, "duplicate member", "members", ref, F.concat(F.col("n").cast("string"), F.lit(" times"))),
        _row_issues(j, "members", ref, [
            (F.col("_p").isNull(), "broken reference", "no such person"), (_bad_email("email"), "bad email", F.col("email")),
        ]),
        _issue(rules.where((filled != 1) | ~expected), "malformed rule", "rules", F.col("rule_id"), F.coalesce("filter_type", F.lit(""))),
    ]
    for name, df in (("members", members), ("rules", rules)):
        parts.append(_issue(df.agg(F.count(F.lit(1)).alias("n")).where("n = 0"), "no data", name, F.lit(None), "table is empty"))
    return reduce(DataFrame.unionByName, parts)


def audit_roles(heads: DataFrame, people: DataFrame) -> DataFrame:
    """Repeated roles, broken links, bad or missing emails, roles without identity."""
    p = people.select("person_id", F.col("email").alias("p_email"), F.lit(True).alias("_p"))
    j = heads.join(p, "person_id", "left")
    linked, found = F.col("person_id").isNotNull(), F.col("_p").isNotNull()
    no_identity = tx.is_blank(F.col("name")) & tx.is_blank(F.col("email"))
    dup = heads.groupBy("org_id", "role_title").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dup_ref = F.concat_ws("/", F.col("org_id").cast("string"), "role_title")
    parts = [
        _issue(dup, "possible duplicate", "heads", dup_ref, F.concat(F.col("n").cast("string"), F.lit(" rows"))),
        _row_issues(j, "heads", F.col("head_id"), [
            (linked & ~found, "broken reference", "no such person"),
            (linked & found & _bad_email("p_email"), "bad email", F.col("p_email")),
            (linked & found & tx.is_blank(F.col("p_email")), "missing email", "linked person has no email"),
            (~linked & _bad_email("email"), "bad email", F.col("email")),
            (~linked & no_identity, "missing identity", "no name or email"),
        ]),
        _issue(heads.agg(F.count(F.lit(1)).alias("n")).where("n = 0"), "no data", "heads", F.lit(None), "table is empty"),
    ]
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Unique:
    columns: Sequence[str]
    where: str | None = None


@dataclass(frozen=True)
class Domain:
    column: str
    values: Sequence[str]


@dataclass(frozen=True)
class OneOf:
    columns: Sequence[str]


def check_invariants(df: DataFrame, key: str, rules: Sequence[Unique | Domain | OneOf]) -> DataFrame:
    """Violations (rule, row_ref, n) of uniqueness, value domains, at-least-one-of."""
    parts, cells = [], []
    for r in rules:
        if isinstance(r, Unique):
            rows = (df.where(r.where) if r.where else df).na.drop(subset=list(r.columns))  # as in SQL, null keys do not repeat
            bad = rows.groupBy(*r.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            name = f"unique({', '.join(r.columns)})" + (f" where {r.where}" if r.where else "")
            ref = F.concat_ws("/", *[F.col(c).cast("string") for c in r.columns])
            parts.append(bad.select(F.lit(name).alias("rule"), ref.alias("row_ref"), "n"))
        elif isinstance(r, Domain):
            c = F.col(r.column)
            cells.append(F.when(c.isNotNull() & ~c.isin(list(r.values)), F.lit(f"domain({r.column})")))
        else:
            none = reduce(lambda a, b: a & b, [tx.is_blank(F.col(c).cast("string")) for c in r.columns])
            cells.append(F.when(none, F.lit(f"one of({', '.join(r.columns)})")))
    if cells:  # all row-level rules in one pass
        broken = df.select(F.explode(F.array_compact(F.array(*cells))).alias("rule"), F.col(key).cast("string").alias("row_ref"))
        parts.append(broken.withColumn("n", F.lit(1).cast("bigint")))
    return reduce(DataFrame.unionByName, parts)


def issue_profile(issues: DataFrame, key: str, issue: str) -> tuple[DataFrame, DataFrame]:
    """(rows per issue type, number of rows by how many types they have)."""
    pairs = issues.select(key, issue).distinct()
    per_type = pairs.groupBy(issue).agg(F.count(F.lit(1)).alias("n_rows"))
    per_row = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n_types"))
    return per_type, per_row.groupBy("n_types").agg(F.count(F.lit(1)).alias("n_rows"))
