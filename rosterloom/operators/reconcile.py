"""Reconciliation of a source of truth A against a store B.

Comparisons aggregate each side (or both sides tagged and unioned) per key
before they meet, so repeated keys never multiply.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import text as tx
from rosterloom.functions.contain import contained, too_short
from rosterloom.functions.joins import join_on
from rosterloom.functions.rules import Rule, first_match
from rosterloom.functions.similar import similar_pairs
from rosterloom.functions.skew import numbered_by_range
from rosterloom.session import durable, spread

from . import pairing


def _sided(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    one, zero = F.lit(1).alias, F.lit(0).alias
    return a.select(*cols, one("in_a"), zero("in_b")).unionByName(b.select(*cols, zero("in_a"), one("in_b")))


def presence_diff(a: DataFrame, b: DataFrame, group: str, key: str) -> DataFrame:
    """Missing / Extra / Duplicate per (group, key); one row per issue."""
    counts = _sided(a, b, [group, key]).groupBy(group, key).agg(
        F.sum("in_a").alias("n_a"), F.sum("in_b").alias("n_b")
    )
    issues = F.array_compact(
        F.array(
            F.when(F.col("n_b") == 0, "Missing"), F.when(F.col("n_a") == 0, "Extra"), F.when(F.col("n_b") > 1, "Duplicate")
        )
    )
    return counts.select(group, key, F.explode(issues).alias("issue"), "n_a", "n_b")


def set_values(a: DataFrame, b: DataFrame, keys: Sequence[str], sets: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Distinct values per (keys, field) with the sides that hold them.

    ``sets`` maps a field to its array expression on A and on B.
    """
    side = lambda df, i, flag: df.select(
        *keys, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), e[i].alias("items")) for f, e in sets.items()])),
    ).select(*keys, "field", F.explode("items").alias("value"), F.lit(flag).alias("side"))
    both = side(a, 0, "a").unionByName(side(b, 1, "b"))
    return both.groupBy(*keys, "field", "value").agg(
        F.max(F.col("side") == "a").alias("in_a"), F.max(F.col("side") == "b").alias("in_b")
    )


def set_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], sets: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Fields whose value sets differ, for keys on both sides (sets united over
    repeated rows): shared, only-in-A and only-in-B counts."""
    shared = join_on(a.select(*keys).distinct(), b.select(*keys).distinct(), keys, "left_semi")
    counts = set_values(a, b, keys, sets).groupBy(*keys, "field").agg(
        F.count_if(F.col("in_a") & F.col("in_b")).alias("n_shared"),
        F.count_if(F.col("in_a") & ~F.col("in_b")).alias("n_a_only"),
        F.count_if(~F.col("in_a") & F.col("in_b")).alias("n_b_only"),
    )
    return join_on(counts.where("n_a_only + n_b_only > 0"), shared, keys, "left_semi")


def perfect_groups(groups: DataFrame, findings: DataFrame, group: str) -> DataFrame:
    """Groups with their number of findings; none means perfect."""
    counts = findings.groupBy(group).agg(F.count(F.lit(1)).alias("n_findings"))
    return groups.join(counts, group, "left").withColumn(
        "n_findings", F.coalesce("n_findings", F.lit(0)).cast("bigint")
    ).withColumn("is_perfect", F.col("n_findings") == 0)


def compare_expr(kind: str, a: Column, b: Column, joined: bool = False) -> Column:
    """Tolerant equality: phones as digit runs (A's within B's), email text within
    B's, anything else by folded text."""
    fa, fb = tx.folded(a), tx.folded(b)
    if kind == "phone":
        runs_a, runs_b = tx.phone_set(a), tx.phone_set(b)
        if joined:
            inside = F.array_join(_runs(b), "").contains(F.array_join(_runs(a), ""))
        else:
            inside = F.size(F.array_except(runs_a, runs_b)) == 0
        return F.when(F.size(runs_a) == 0, (fa == "") | fb.contains(fa)).otherwise(inside)
    if kind == "email":
        return F.when(fa == "", fb == "").otherwise(fb.contains(fa))
    if kind == "text":
        return fa == fb
    raise ValueError(f"unknown kind {kind!r}")


def _runs(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({tx.PHONE_RUN})"), F.lit(1))


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "text"


def _first_rows(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], side: str) -> DataFrame:
    have = [c for c in cols if c in df.columns]
    first = df.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in have if c != order])).alias("f"))
    out = [F.col(f"f.{c}").alias(f"{side}_{c}") for c in dict.fromkeys([order, *have])]
    return first.select(*keys, *out, F.lit(True).alias(f"in_{side}"))


def field_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], order: str, fields: Sequence[Field]) -> DataFrame:
    """Long rows (keys, field, a_value, b_value, match).

    match: yes, no, a_only / b_only for whole records, not_comparable when A has
    no such column.  Repeated keys use their smallest ``order`` on both sides.
    """
    names = [f.name for f in fields]
    j = join_on(_first_rows(a, keys, order, names, "a"), _first_rows(b, keys, order, names, "b"), keys, "full")
    cells = []
    for f in fields:
        bv = F.col(f"b_{f.name}").cast("string")
        if f.name in a.columns:
            av = F.col(f"a_{f.name}").cast("string")
            match = F.when(compare_expr(f.kind, av, bv), "yes").otherwise("no")
        else:
            av, match = F.lit(None).cast("string"), F.lit("not_comparable")
        cells.append(F.struct(F.lit(f.name).alias("field"), av.alias("a_value"), bv.alias("b_value"), match.alias("match")))
    null = F.lit(None).cast("string")
    whole = lambda m: F.array(
        F.struct(F.lit("(record)").alias("field"), null.alias("a_value"), null.alias("b_value"), F.lit(m).alias("match"))
    )
    rows = F.when(F.col("in_b").isNull(), whole("a_only")).when(F.col("in_a").isNull(), whole("b_only")).otherwise(F.array(*cells))
    return j.select(*keys, F.inline(rows))


def compare_entities(
    a: DataFrame, b: DataFrame, keys: Sequence[str], order: str,
    title: str | None = None, phone: str | None = None, email: str | None = None, report_missing: bool = True,
) -> DataFrame:
    """Spec-driven comparison of two entity lists: (keys, issue, current, expected).

    Issues: missing, extra, title, phone / phone_blank, email / email_blank.
    Comparable fields must be filled in A; blank in B is its own issue.
    """
    used = [c for c in (title, phone, email) if c]
    j = join_on(_first_rows(a, keys, order, used, "a"), _first_rows(b, keys, order, used, "b"), keys, "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    row = lambda test, issue, cur, exp: F.when(
        test, F.struct(F.lit(issue).alias("issue"), cur.alias("current"), exp.alias("expected"))
    )
    null = F.lit(None).cast("string")
    cells = [row(F.col("in_a").isNull(), "extra", null, null)]
    if report_missing:
        cells.append(row(F.col("in_b").isNull(), "missing", null, null))
    if title:
        ta, tb = F.col(f"a_{title}"), F.col(f"b_{title}")
        cells.append(row(both & ~tx.is_blank(ta) & ~tx.is_blank(tb) & (F.lower(ta) != F.lower(tb)), "title", tb, ta))
    for col, to_set, issue in ((phone, tx.phone_set, "phone"), (email, tx.email_set, "email")):
        if col:
            sa, sb = to_set(F.col(f"a_{col}")), to_set(F.col(f"b_{col}"))
            ja, jb = F.array_join(sa, ", "), F.array_join(sb, ", ")
            cells.append(row(both & (F.size(sa) > 0) & (F.size(sb) > 0) & (sa != sb), issue, jb, ja))
            cells.append(row(both & (F.size(sa) > 0) & (F.size(sb) == 0), f"{issue}_blank", jb, ja))
    return j.select(*keys, F.inline(F.array_compact(F.array(*cells))))


def wrong_group(a: DataFrame, b: DataFrame, group: str, name: str, b_id: str) -> DataFrame:
    """B rows with no A row of their name in the same group: where A has the name."""
    ka = a.select(group, tx.folded(F.col(name)).alias("_k")).distinct()
    rest = join_on(b.withColumn("_k", tx.folded(F.col(name))), ka, [group, "_k"], "left_anti")
    where = ka.groupBy("_k").agg(F.count(F.lit(1)).alias("n_groups"), F.min(group).alias("_only"))
    n = F.coalesce("n_groups", F.lit(0))
    status = F.when(n == 0, "not_found").when(n == 1, "wrong_group").otherwise("ambiguous")
    return rest.join(where, "_k", "left").select(
        b_id, name, F.col(group).alias("current_group"), F.when(n == 1, F.col("_only")).alias("expected_group"), status.alias("status")
    )


def pair_artifacts(findings: DataFrame, generic: Sequence[str] = ("control room",)) -> DataFrame:
    """Missing/Extra pairs that are only naming differences.

    First equal normalized labels within (station, category), by occurrence; then
    a generic Missing label with an Extra that carries the station's own name.
    Returns (missing_id, extra_id, pattern).
    """
    f = findings.where(F.col("category").isin("Control Room", "Switchyard"))
    f = f.withColumn("_key", tx.match_key(F.col("name"))).withColumn(
        "_own", tx.match_key(tx.strip_serial(F.col("name"))) == tx.match_key(F.col("station"))
    )
    f = durable(f.select("finding_id", "station", "category", "issue", "_key", "_own"))  # slim, read by every step below
    missing = f.where("issue = 'Missing'").withColumnRenamed("finding_id", "missing_id")
    extra = f.where("issue = 'Extra'").withColumnRenamed("finding_id", "extra_id")
    named = (F.col("_key") != "")
    equal = durable(pairing.pair_by_occurrence(
        missing.where(named), extra.where(named), ["station", "category", "_key"], "missing_id", "extra_id"
    ))
    rest_m = missing.join(equal, "missing_id", "left_anti").where(F.col("_key").isin(list(generic)) & (F.col("category") == "Control Room"))
    rest_e = extra.join(equal, "extra_id", "left_anti").where(F.col("_own"))
    own = pairing.pair_by_occurrence(rest_m, rest_e, ["station", "category"], "missing_id", "extra_id")
    return equal.select("missing_id", "extra_id", F.lit("equal label").alias("pattern")).unionByName(
        own.select("missing_id", "extra_id", F.lit("generic label").alias("pattern"))
    )


def pair_fuzzy(findings: DataFrame, threshold: float = 0.88, min_length: int = 4, blocks: bool = False) -> DataFrame:
    """Pair remaining Missing and Extra findings of a (station, category) whose
    labels are nearly equal, best first, one partner each.

    Likeness is by edits, or with ``blocks`` by longest matching blocks.  Labels under
    ``min_length`` take no part: ``short_findings`` returns them.
    """
    block = ["station", "category"]
    # dealt over all tasks, as a small file is one split; slim, read by every step below
    f = spread(findings.select("finding_id", *block, "issue", "name"), "finding_id")
    f = durable(f.withColumn("_k", tx.match_key(F.col("name"))).drop("name")).where(F.length("_k") >= min_length)
    missing = f.where("issue = 'Missing'").withColumnRenamed("finding_id", "missing_id")
    extra = f.where("issue = 'Extra'").withColumnRenamed("finding_id", "extra_id")
    edges = similar_pairs(missing, "_k", extra, "_k", block, threshold, blocks)
    edges = edges.select(*block, "a_name", "b_name", pairing.score_of(F.col("similarity")).alias("score"))
    assigned = pairing.assign_names(
        edges, block, pairing.name_counts(missing, block, "_k"), pairing.name_counts(extra, block, "_k")
    )
    pairs = pairing.pair_rows(assigned, missing, extra, block, "_k", "missing_id", "extra_id")
    return pairs.select("missing_id", "extra_id", F.round(1 - F.col("score"), 4).alias("similarity"))


def short_findings(findings: DataFrame, min_length: int = 4) -> DataFrame:
    """The findings that ``pair_fuzzy`` leaves out because their label is too short to compare."""
    return too_short(findings, tx.match_key(F.col("name")), min_length).select("finding_id", "station", "category", "issue", "name", "status")


def format_only(diff: DataFrame, a: str, b: str) -> DataFrame:
    """Add ``format_only``: the two phone texts share a canonical number."""
    numbers = lambda c: F.array_compact(
        F.transform(tx.segments(F.col(c)), lambda p: tx.national_number(p, "lenient"))
    )
    return diff.withColumn("format_only", F.coalesce(F.arrays_overlap(numbers(a), numbers(b)), F.lit(False)))


def issue_origin(a_issues: DataFrame, b_issues: DataFrame, group: str, issue: str) -> DataFrame:
    """Where a group's issues come from, by comparing issue types per group."""
    types = _sided(a_issues, b_issues, [group, issue]).groupBy(group, issue).agg(
        F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b")
    )
    n = types.groupBy(group).agg(
        F.sum("in_a").cast("bigint").alias("n_source"), F.sum("in_b").cast("bigint").alias("n_store"),
        F.count_if(F.col("in_a") + F.col("in_b") == 2).alias("n_both"),
    )
    origin = (
        F.when((F.col("n_both") > 0) & (F.col("n_both") == F.col("n_store")), "in source")
        .when((F.col("n_store") > 0) & (F.col("n_source") == 0), "introduced")
        .when((F.col("n_store") > 0) & (F.col("n_source") > 0), "mixed")
        .otherwise("source only")
    )
    return n.withColumn("origin", origin)


@dataclass(frozen=True)
class Triage:
    rule: Rule
    confidence: str


def triage(findings: DataFrame, rules: Sequence[Triage], default: tuple[str, str] = ("Warning", "Low")) -> DataFrame:
    """Class and confidence of each finding, first rule that holds."""
    confidence = {id(t.rule): t.confidence for t in rules}
    plain = [t.rule for t in rules]
    return findings.withColumns(
        {
            "triage_class": first_match(plain, default[0]),
            "confidence": first_match(plain, default[1], pick=lambda r: confidence[id(r)]),
        }
    )


def recon_summary(total: DataFrame, findings: DataFrame, incorrect: Sequence[str], missing: Sequence[str], manual: Sequence[str]) -> DataFrame:
    """One row: totals by outcome, accuracy, share of confidently read records."""
    kind = F.col("issue")
    counts = findings.agg(
        F.count_if(kind.isin(list(incorrect))).alias("incorrect"),
        F.count_if(kind.isin(list(missing))).alias("missing"),
        F.count_if(kind.isin(list(manual))).alias("manual"),
    )
    n = total.agg(F.struct(F.count(F.lit(1)).alias("total"), F.count_if("is_confident").alias("confident"))).scalar()
    one = counts.withColumn("_n", n).select("*", "_n.total", "_n.confident").drop("_n")
    one = one.withColumn("correct", F.greatest(F.expr("total - incorrect - missing - manual"), F.lit(0)))
    pct = lambda part, whole, empty: F.when(F.expr(whole) == 0, F.lit(empty)).otherwise(
        F.round(100.0 * F.expr(part) / F.nullif(F.expr(whole), F.lit(0)), 2)
    )
    return one.withColumns(
        {
            "accuracy_pct": pct("correct", "correct + incorrect + manual", 0.0),
            "confidence_pct": pct("confident", "total", 100.0),
        }
    )


def suggest_moves(findings: DataFrame, stations: DataFrame, records: DataFrame) -> DataFrame:
    """Move suggestions per name from Missing / Extra findings.

    One of each is a HIGH move, lowered when the target is not a known station or
    the source row is not there; several are MEDIUM; one side only is LOW.
    """
    per = findings.withColumn("_name", tx.folded(F.col("name"))).groupBy("_name").agg(
        F.count_if(F.col("issue") == "Missing").alias("n_missing"),
        F.count_if(F.col("issue") == "Extra").alias("n_extra"),
        F.min(F.when(F.col("issue") == "Missing", F.col("station"))).alias("_to"),
        F.min(F.when(F.col("issue") == "Extra", F.col("station"))).alias("_from"),
    ).where("n_missing + n_extra > 0")
    one = (F.col("n_missing") == 1) & (F.col("n_extra") == 1)
    known = stations.select(F.col("station").alias("_to")).distinct().withColumn("_known", F.lit(True))
    held = records.select(F.col("station").alias("_from"), tx.folded(F.col("name")).alias("_name")).distinct().withColumn("_held", F.lit(True))
    j = per.join(known, "_to", "left").join(held, ["_from", "_name"], "left")
    confidence = (
        F.when(one & F.col("_known").isNotNull() & F.col("_held").isNotNull(), "HIGH")
        .when(one, "LOW")
        .when((F.col("n_missing") > 0) & (F.col("n_extra") > 0), "MEDIUM")
        .otherwise("LOW")
    )
    action = F.when((F.col("n_missing") > 0) & (F.col("n_extra") > 0), "move").otherwise("ignore")
    reason = (
        F.when(one & F.col("_known").isNull(), "target station unknown")
        .when(one & F.col("_held").isNull(), "source row not found")
        .when(one, "one Missing and one Extra")
        .when(action == "move", "several candidates")
        .when(F.col("n_missing") > 0, "Missing only")
        .otherwise("Extra only")
    )
    return j.select(
        F.col("_name").alias("name_key"), action.alias("action"), confidence.alias("confidence"), reason.alias("reason"),
        F.when(one, F.col("_from")).alias("from_station"), F.when(one, F.col("_to")).alias("to_station"), "n_missing", "n_extra",
    )


def suggest_merges(df: DataFrame, group: str, name: str, title: str) -> DataFrame:
    """Names repeated within a group: same title is a merge, else LOW."""
    return (
        df.groupBy(group, tx.folded(F.col(name)).alias("name_key"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(tx.folded(F.col(title))).alias("n_titles"))
        .where("n_rows > 1")
        .withColumn("confidence", F.when(F.col("n_titles") == 1, "HIGH").otherwise("LOW"))
    )


def suggest_place_moves(findings: DataFrame, category: str) -> DataFrame:
    """Missing places with an Extra place of overlapping station name, one partner
    each, closest length first; the rest without a partner.  All are LOW."""
    f = findings.where(F.col("category") == category).withColumn("_k", F.lower(tx.strip_serial(tx.clean(F.col("station")))))
    f = f.withColumn("_b", F.lit(category))
    missing = f.where("issue = 'Missing'").withColumnRenamed("finding_id", "missing_id")
    extra = f.where("issue = 'Extra'").withColumnRenamed("finding_id", "extra_id")
    am, be = missing.select(F.col("_k").alias("a_name")), extra.select(F.col("_k").alias("b_name"))
    pairs = contained(am, "a_name", be, "b_name", 1).unionByName(contained(be, "b_name", am, "a_name", 1)).distinct()
    edges = pairs.select(
        F.lit(category).alias("_b"), "a_name", "b_name", F.abs(F.length("a_name") - F.length("b_name")).cast("double").alias("score")
    )
    assigned = pairing.assign_names(
        edges, ["_b"], pairing.name_counts(missing, ["_b"], "_k"), pairing.name_counts(extra, ["_b"], "_k")
    )
    got = pairing.pair_rows(assigned, missing, extra, ["_b"], "_k", "missing_id", "extra_id")
    return missing.select("missing_id", "station").join(got.select("missing_id", "extra_id"), "missing_id", "left").withColumn(
        "confidence", F.lit("LOW")
    )


def pending(suggestions: DataFrame, decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Suggestions not yet approved or rejected; skipped ones stay."""
    done = decisions.where(F.col("decision").isin("approved", "rejected")).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return suggestions.join(done, same, "left_anti")


def proposal_batches(diff: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Proposals to apply from a field diff: mismatches of the wanted fields with a
    usable A value, and whole records missing in B as inserts."""
    usable = ~F.coalesce(F.lower(F.trim("a_value")), F.lit("")).isin(list(tx.PLACEHOLDERS))
    update = (F.col("match") == "no") & F.col("field").isin(list(fields)) & usable
    insert = F.col("match") == "a_only"
    return diff.where(update | insert).select(
        F.when(insert, "insert").otherwise(F.concat(F.lit("update "), F.col("field"))).alias("batch"),
        *keys, F.col("b_value").alias("current_value"), F.col("a_value").alias("proposed_value"),
    )


def batch_sample(batches: DataFrame, batch: str, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` proposals of a batch, for review."""
    return batches.where(F.col("batch") == batch).orderBy(*order).limit(n)


def one_sided_counts(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("match").isin("a_only", "b_only")).groupBy("match").agg(F.count(F.lit(1)).alias("n_records"))


def missing_rows(a: DataFrame, b: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Values in A but not in B, as rows to add under the next ids."""
    fresh = join_on(a.select(*keys).distinct(), b.select(*keys).distinct(), keys, "left_anti")
    top = b.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    numbered = numbered_by_range(fresh, [], list(keys), "_no")
    return numbered.select((top + F.col("_no")).cast("bigint").alias(id_col), *keys)


def verified_reassign(a: DataFrame, b: DataFrame, name: str, station: str, b_id: str) -> DataFrame:
    """Reassign B rows to the only station A lists their name at, if no B row holds
    that name there already; anything else is review."""
    key = tx.folded(F.col(name))
    spots = a.select(key.alias("_k"), F.col(station).alias("_s")).distinct()
    only = spots.groupBy("_k").agg(F.count(F.lit(1)).alias("n_stations"), F.min("_s").alias("_to"))
    held = b.select(key.alias("_k"), F.col(station).alias("_to")).distinct().withColumn("_held", F.lit(True))
    j = join_on(b.withColumn("_k", key).join(only, "_k", "left"), held, ["_k", "_to"], "left")
    n = F.coalesce("n_stations", F.lit(0))
    status = (
        F.when(n == 0, "review: not in source")
        .when(n > 1, "review: several stations")
        .when(F.col("_to").eqNullSafe(F.col(station)), "in place")
        .when(F.col("_held").isNotNull(), "review: already held")
        .otherwise("reassign")
    )
    return j.select(b_id, F.col(station).alias("from_station"), F.when(status == "reassign", F.col("_to")).alias("to_station"), status.alias("status"))
