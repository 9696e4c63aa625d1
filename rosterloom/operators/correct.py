"""Corrections: propose from evidence, apply with guards, keep what was refused.

Proposing and applying are separate calls, and an unsettled case becomes a
problem or review row instead of a guess.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import text as tx
from rosterloom.functions.joins import join_on
from rosterloom.functions.skew import numbered_by_range

from .reconcile import _first_rows, wrong_group
from .standardize import change_log


def propose(a: DataFrame, b: DataFrame, keys: Sequence[str], b_id: str, order: str, title: str, phone: str, email: str) -> DataFrame:
    """Change proposals for B from A: (keys, row_id, field, action, old_value, new_value, confidence).

    Blank in B is filled; a single-purpose field that differs is updated; a phone
    that differs, or an email where B holds several, is left to a person.
    """
    cols = [title, phone, email]
    j = join_on(_first_rows(a, keys, order, cols, "a"), _first_rows(b, keys, order, [*cols, b_id], "b"), keys, "left")
    j = j.where(F.col("in_a").isNotNull())
    both = F.col("in_b").isNotNull()

    def row(test, field, action, old, new, confidence):
        cell = F.struct(
            F.lit(field).alias("field"), F.lit(action).alias("action"), old.cast("string").alias("old_value"),
            new.cast("string").alias("new_value"), F.lit(confidence).alias("confidence"),
        )
        return F.when(test, cell)

    ta, tb = F.col(f"a_{title}"), F.col(f"b_{title}")
    pa, pb = tx.phone_set(F.col(f"a_{phone}")), tx.phone_set(F.col(f"b_{phone}"))
    ea, eb = tx.email_set(F.col(f"a_{email}")), tx.email_set(F.col(f"b_{email}"))
    text = lambda s: F.array_join(s, ", ")
    has = lambda s: F.size(s) > 0
    null = F.lit(None)
    cells = [
        row(~both, "(record)", "insert", null, null, "High"),
        row(both & ~tx.is_blank(ta) & ~tx.is_blank(tb) & (F.lower(ta) != F.lower(tb)), title, "update", tb, ta, "High"),
        row(both & has(pa) & ~has(pb), phone, "fill", null, text(pa), "High"),
        row(both & has(pa) & has(pb) & (pa != pb), phone, "manual", text(pb), text(pa), "Low"),
        row(both & has(ea) & ~has(eb), email, "fill", null, text(ea), "High"),
        row(both & has(ea) & (F.size(eb) > 1) & (ea != eb), email, "manual", text(eb), text(ea), "Low"),
        row(both & has(ea) & (F.size(eb) == 1) & (ea != eb), email, "update", text(eb), text(ea), "High"),
    ]
    return j.select(*keys, F.col(f"b_{b_id}").alias("row_id"), F.inline(F.array_compact(F.array(*cells))))


def propose_remap(a: DataFrame, b: DataFrame, name: str, b_id: str, tree: DataFrame) -> DataFrame:
    """Both levels of rows found under the wrong organization: (row_id, field, new_value).

    A child target also sets its parent; a top-level target clears the child.
    """
    wrong = wrong_group(a, b, "org_id", name, b_id).where("status = 'wrong_group'")
    t = tree.select(F.col("org_id").alias("expected_group"), "parent_id")
    j = wrong.join(t, "expected_group")
    top = F.col("parent_id").isNull()
    cells = F.array(
        F.struct(F.lit("child_id").alias("field"), F.when(~top, F.col("expected_group")).cast("string").alias("new_value")),
        F.struct(F.lit("parent_id").alias("field"), F.coalesce("parent_id", "expected_group").cast("string").alias("new_value")),
    )
    return j.select(F.col(b_id).alias("row_id"), F.inline(cells))


def apply_changes(target: DataFrame, key: str, changes: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Apply (row_id, change_id, action, field, new_value) to a table: (rows, problems).

    update: the last change per row and field wins, cast to the column's type;
    delete: the row goes; insert: changes sharing a ``row_id`` become one new row
    under the next id; manual: skipped.  A field that does not
    exist, a value that does not fit its type, or a row that is not there is a
    problem.  Rows no change addresses stay as they are.
    """
    types = {f.name: f.dataType.simpleString() for f in target.schema.fields}
    fields = [c for c in types if c != key]
    fits = F.lit(False)
    for c in fields:
        value = F.col("new_value")
        fits = F.when(F.col("field") == c, value.isNull() | F.expr(f"try_cast(new_value AS {types[c]})").isNotNull()).otherwise(fits)
    ids = target.select(F.col(key).alias("row_id"), F.lit(True).alias("_there"))
    active = changes.where(F.col("action").isin("update", "insert", "delete")).join(ids, "row_id", "left")
    problem = (
        F.when((F.col("action") != "insert") & F.col("_there").isNull(), "row not found")
        .when((F.col("action") != "delete") & ~F.col("field").isin(fields), "unknown field")
        .when((F.col("action") != "delete") & ~fits, "value does not fit")
    )
    active = active.withColumn("problem", problem)
    problems = active.where(F.col("problem").isNotNull()).select("row_id", "action", "field", "new_value", "problem")
    good = active.where(F.col("problem").isNull())

    def pivoted(df: DataFrame) -> DataFrame:
        aggs = []
        for c in fields:
            at = F.when(F.col("field") == c, F.col(order))
            aggs += [F.max_by("new_value", at).alias(f"_n_{c}"), F.count(at).alias(f"_c_{c}")]
        return df.groupBy("row_id").agg(*aggs)

    typed = lambda c: F.expr(f"try_cast(`_n_{c}` AS {types[c]})")
    updates = pivoted(good.where("action = 'update'")).withColumnRenamed("row_id", key)
    gone = good.where("action = 'delete'").select(F.col("row_id").alias(key)).distinct()
    kept = target.join(gone, key, "left_anti").join(updates, key, "left").select(
        key, *[F.when(F.col(f"_c_{c}") > 0, typed(c)).otherwise(F.col(c)).alias(c) for c in fields]
    )
    top = target.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
    fresh = numbered_by_range(pivoted(good.where("action = 'insert'")), [], ["row_id"], "_no")
    added = fresh.select((top + F.col("_no")).cast(types[key]).alias(key), *[typed(c).alias(c) for c in fields])
    return kept.unionByName(added), problems


def apply_guarded(
    people: DataFrame, proposals: DataFrame, orgs: DataFrame, field: str, excluded: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Fill one blank field from proposals (org_name, person_name, new_value).

    Applied only if the organization exists, exactly one of its people has the
    name, the value is blank and the person is not excluded; otherwise a problem.
    """
    name = tx.folded(F.col("person_name"))
    o = orgs.groupBy(tx.folded(F.col("org_name")).alias("_o")).agg(F.min("org_id").alias("org_id"))
    held = people.groupBy("org_id", name.alias("_k")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("person_id").alias("person_id"), F.min(field).alias("_v")
    )
    p = proposals.select("proposal_id", tx.folded(F.col("org_name")).alias("_o"), name.alias("_k"), "new_value")
    j = p.join(o, "_o", "left").join(held, ["org_id", "_k"], "left")
    j = j.join(excluded.select("person_id").distinct().withColumn("_x", F.lit(True)), "person_id", "left")
    problem = (
        F.when(F.col("org_id").isNull(), "organization not found")
        .when(F.col("_n").isNull(), "person not found")
        .when(F.col("_n") > 1, "several people")
        .when(F.col("_x").isNotNull(), "excluded")
        .when(~tx.is_blank(F.col("_v")), "not blank")
    )
    j = j.withColumn("problem", problem)
    ok = j.where(F.col("problem").isNull()).groupBy("person_id").agg(F.min_by("new_value", "proposal_id").alias("_new"))
    done = people.join(ok, "person_id", "left").withColumn(field, F.coalesce("_new", field)).drop("_new")
    return done, j.where(F.col("problem").isNotNull()).select("proposal_id", "problem")


def apply_decisions(rows: DataFrame, key: str, name: str, org: str, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply approved decisions (decision_id, name, old_org, action, new_org): (rows, not found).

    move sets the organization of the named rows at the old one; merge keeps the
    lowest id of them; ignore does nothing.  Organizations compare null-safe.
    """
    d = decisions.select("decision_id", tx.folded(F.col("name")).alias("_k"), F.col("old_org").alias("_old"), "action", "new_org")
    act = d.where("action IN ('move', 'merge')")
    first = act.groupBy("_k", "_old").agg(F.min_by(F.struct("action", "new_org"), F.col("decision_id")).alias("_d"))
    base = rows.withColumn("_k", tx.folded(F.col(name))).alias("r")
    same = (F.col("r._k") == F.col("d._k")) & F.col(f"r.{org}").eqNullSafe(F.col("d._old"))
    j = base.join(first.alias("d"), same, "left").select("r.*", "_d")
    merged = j.where(F.col("_d.action") == "merge").groupBy("_k", org).agg(F.min(key).alias("_keep"))
    lost = j.alias("j").join(merged.alias("m"), (F.col("j._k") == F.col("m._k")) & F.col(f"j.{org}").eqNullSafe(F.col(f"m.{org}"))).where(
        (F.col("_d.action") == "merge") & (F.col(f"j.{key}") != F.col("_keep"))
    ).select(F.col(f"j.{key}").alias(key))
    moved = F.when(F.col("_d.action") == "move", F.col("_d.new_org")).otherwise(F.col(org)).alias(org)
    kept = j.join(lost, key, "left_anti").select(*[moved if c == org else F.col(c) for c in rows.columns])
    keys = rows.select(tx.folded(F.col(name)).alias("_rk"), F.col(org).alias("_ro")).distinct()
    missing = act.join(keys, (F.col("_k") == F.col("_rk")) & F.col("_old").eqNullSafe(F.col("_ro")), "left_anti")
    return kept, missing.select("decision_id", "action")


def audit_rows(before: DataFrame, after: DataFrame, key: str, cols: Sequence[str], table: str, reason: str) -> DataFrame:
    """Long change audit between two states of a table; unchanged cells dropped."""
    old = before.select(key, *[F.col(c).alias(f"_o_{c}") for c in cols])
    j = after.join(old, key)
    log = change_log(j, key, [(c, F.col(f"_o_{c}"), F.col(c), reason) for c in cols])
    return log.select(F.lit(table).alias("table_name"), F.col(key).alias("row_id"), "field", "old_value", "new_value", "reason")


def requests_to_changes(requests: DataFrame, field_map: Mapping[str, str], legacy: Mapping[str, str], target: str) -> DataFrame:
    """Approved requests as changes (row_id, change_id, action, field, new_value).

    A generic request names its field freely; a legacy one fills columns.  A field
    that maps nowhere keeps its name, so applying it reports a problem.
    """
    live = requests.where("status = 'APPROVED'")
    key = F.regexp_replace(F.lower(F.trim(F.regexp_replace("field_name", r"[.]", ""))), r"\s+", "_")
    mapped = F.col("_key")
    for raw, col in field_map.items():
        mapped = F.when(F.col("_key") == raw, F.lit(col)).otherwise(mapped)
    generic = F.col("field_name").isNotNull() & F.col("new_value").isNotNull()
    cells = [F.when(generic, F.struct(mapped.alias("field"), F.col("new_value").alias("value")))]
    for raw, col in legacy.items():
        cells.append(F.when(~generic & ~tx.is_blank(F.col(raw)), F.struct(F.lit(col).alias("field"), F.col(raw).alias("value"))))
    return live.withColumn("_key", key).select(
        F.col(target).alias("row_id"), F.col("request_id").alias("change_id"), F.lit("update").alias("action"),
        F.inline(F.array_compact(F.array(*cells))),
    ).withColumnRenamed("value", "new_value")


def route_linked(changes: DataFrame, heads: DataFrame, contact_fields: Sequence[str]) -> DataFrame:
    """Changes to contact fields of a linked role holder go to the person instead."""
    link = heads.where("person_id IS NOT NULL").select(F.col("head_id").alias("row_id"), "person_id")
    to_person = F.col("person_id").isNotNull() & F.col("field").isin(list(contact_fields))
    return changes.join(link, "row_id", "left").select(
        F.when(to_person, "person").otherwise("role").alias("target_table"),
        F.when(to_person, F.col("person_id")).otherwise(F.col("row_id")).alias("row_id"),
        "change_id", "action", "field", "new_value",
    )


def apply_curated(
    df: DataFrame, key: str, name: str, org: str, renames: DataFrame, deletes: DataFrame, reassigns: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Curated fixes by exact name: (rows, report).

    renames (old_name, new_name), deletes (old_name), reassigns (old_name, new_org).
    The report lists map entries that matched nothing.
    """
    r = renames.groupBy(F.col("old_name").alias(name)).agg(F.min("new_name").alias("_name"))
    s = reassigns.groupBy(F.col("old_name").alias(name)).agg(F.min("new_org").alias("_org"))
    d = deletes.select(F.col("old_name").alias(name)).distinct()
    out = df.join(d, name, "left_anti").join(r, name, "left").join(s, name, "left")
    rows = out.withColumns({org: F.coalesce("_org", org)}).withColumn(name, F.coalesce("_name", name)).select(*df.columns)
    names = df.select(F.col(name).alias("old_name")).distinct()
    report = [
        m.select("old_name").distinct().join(names, "old_name", "left_anti").withColumn("fix", F.lit(kind))
        for kind, m in (("rename", renames), ("delete", deletes), ("reassign", reassigns))
    ]
    return rows, reduce(DataFrame.unionByName, report).select("fix", "old_name")


def conservation(whole: DataFrame, parts: Sequence[DataFrame], cols: Sequence[str]) -> DataFrame:
    """Check that parts add up to the whole, as multisets of the given columns."""
    w = whole.select(*cols)
    p = reduce(DataFrame.unionAll, [x.select(*cols) for x in parts])
    tagged = w.withColumn("_d", F.lit(1)).unionAll(p.withColumn("_d", F.lit(-1)))
    balance = tagged.groupBy(*cols).agg(F.sum("_d").alias("_d"), F.count_if(F.col("_d") > 0).alias("_w"), F.count_if(F.col("_d") < 0).alias("_p"))
    return balance.agg(
        F.coalesce(F.sum("_w"), F.lit(0)).alias("n_whole"), F.coalesce(F.sum("_p"), F.lit(0)).alias("n_parts"),
        F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)).alias("n_lost"),
        F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).alias("n_added"),
    ).withColumn("is_conserved", F.expr("n_lost = 0 AND n_added = 0"))


def assert_conserved(whole: DataFrame, parts: Sequence[DataFrame], cols: Sequence[str]) -> None:
    if conservation(whole, parts, cols).where("NOT is_conserved").count():
        raise AssertionError("parts do not add up to the whole")


def validate_rows(rows: DataFrame, target: DataFrame, key: str, name: str, org: str, orgs: DataFrame) -> DataFrame:
    """Problems of incoming rows: blank name, bad email or phone, unknown
    organization, already stored, repeated in the input."""
    k = tx.folded(F.col(name))
    stored = target.select(tx.folded(F.col(name)).alias("_k"), F.col(org)).distinct().withColumn("_stored", F.lit(True))
    known = orgs.select(F.col("org_id").alias(org)).distinct().withColumn("_known", F.lit(True))
    again = rows.groupBy(k.alias("_k"), org).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_first"))
    j = rows.withColumn("_k", k).join(stored, ["_k", org], "left").join(known, org, "left").join(again, ["_k", org], "left")
    problems = F.array_compact(F.array(
        F.when(tx.is_blank(F.col(name)), "blank name"),
        F.when(~tx.is_blank(F.col("email")) & ~tx.is_email(F.col("email")), "bad email"),
        F.when(~tx.is_blank(F.col("mobile")) & tx.national_number(F.col("mobile"), "strict").isNull(), "bad phone"),
        F.when(F.col("_known").isNull(), "unknown organization"),
        F.when(F.col("_stored").isNotNull(), "already stored"),
        F.when((F.col("_n") > 1) & (F.col(key) != F.col("_first")), "repeated"),
    ))
    return j.select(key, F.explode(problems).alias("problem"))


def readiness(reviewed: DataFrame, critical: DataFrame) -> DataFrame:
    """Share of reviewed records without a critical finding."""
    n = reviewed.agg(F.count(F.lit(1)).alias("n_reviewed")).withColumn("n_critical", critical.agg(F.count(F.lit(1))).scalar())
    pct = F.round(100.0 * (F.col("n_reviewed") - F.col("n_critical")) / F.nullif("n_reviewed", F.lit(0)), 2)
    return n.withColumn("readiness_pct", F.coalesce(pct, F.lit(0.0)).cast("double"))
