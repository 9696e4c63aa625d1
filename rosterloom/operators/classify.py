"""Rule classification and category maintenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import text as tx
from rosterloom.functions.rules import Rule, all_results, first_match


def classify(df: DataFrame, key: str, rules: Sequence[Rule], default: str, id_lists: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """First matching rule's class; the default needs review.

    Curated id lists are tables, joined as boolean columns ``in_<list>`` that rules
    can test.
    """
    for name, ids in (id_lists or {}).items():
        mark = ids.select(key).distinct().withColumn(f"in_{name}", F.lit(True))
        df = df.join(mark, key, "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    hit = first_match(rules)
    review = first_match(rules, "yes", pick=lambda r: "yes" if r.review else "no") == "yes"
    return df.withColumns({"new_class": F.coalesce(hit, F.lit(default)), "needs_review": review})


def keyword_class(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Class whose keywords occur; undecided (null) when two classes match."""
    hits = all_results(rules)
    return df.withColumns(
        {"keyword_class": F.when(F.size(hits) == 1, F.get(hits, F.lit(0))), "n_classes": F.size(hits).cast("bigint")}
    )


def apply_mapping(df: DataFrame, mapping: DataFrame, key: str, col: str, default: str) -> DataFrame:
    """Curated key -> class with a default: (key, old_value, new_value) of changes."""
    m = mapping.select(key, F.col("new_value").alias("_m"))
    return (
        df.join(m, key, "left")
        .select(key, F.col(col).alias("old_value"), F.coalesce("_m", F.lit(default)).alias("new_value"))
        .where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    )


def section_check(orgs: DataFrame, key: str, category: str, sections: DataFrame, mapping: DataFrame, ambiguous: Sequence[str]) -> DataFrame:
    """Actual class against the class implied by the source section.

    Buckets: match, mismatch, none, several, ambiguous, unmapped.
    """
    per = sections.select(key, "section").distinct().groupBy(key).agg(
        F.count(F.lit(1)).alias("n_sections"), F.min("section").alias("section")
    )
    j = orgs.join(per, key, "left").join(mapping.select("section", "implied"), "section", "left")
    n = F.coalesce("n_sections", F.lit(0))
    bucket = (
        F.when(n == 0, "none")
        .when(n > 1, "several")
        .when(F.col("section").isin(list(ambiguous)), "ambiguous")
        .when(F.col("implied").isNull(), "unmapped")
        .when(F.col("implied").eqNullSafe(F.col(category)), "match")
        .otherwise("mismatch")
    )
    return j.select(key, category, F.when(n == 1, F.col("section")).alias("section"), F.when(n == 1, F.col("implied")).alias("implied"), bucket.alias("bucket"))


def propose_class(df: DataFrame, key: str, col: str, category: str, keywords: Mapping[str, str], renames: Mapping[str, str], open_class: str) -> DataFrame:
    """Class proposals: keyword in the name, else a category rename; no-ops omitted.

    Two keywords, or a keyword against a decided category, are flagged instead.
    """
    low = F.lower(F.coalesce(F.col(col), F.lit("")))
    words = [F.when(low.contains(w), F.lit(c)) for w, c in keywords.items()]
    hits = F.array_distinct(F.array_compact(F.array(*words)))
    only = F.get(hits, F.lit(0))
    current = F.coalesce(F.col(category), F.lit("(none)"))
    renamed = F.lit(None).cast("string")
    for old, new in renames.items():
        renamed = F.when(current == old, F.lit(new)).otherwise(renamed)
    flag = F.when(F.size(hits) > 1, "both keywords").when(
        (F.size(hits) == 1) & (only != current) & (current != open_class), "overrides existing"
    )
    proposed = F.when(flag.isNotNull(), None).when(F.size(hits) == 1, only).otherwise(renamed)
    return df.select(key, current.alias("current_class"), proposed.alias("proposed_class"), flag.alias("flag")).where(
        F.col("flag").isNotNull() | (F.col("proposed_class").isNotNull() & (F.col("proposed_class") != F.col("current_class")))
    )


def propose_membership(
    df: DataFrame, key: str, col: str, category: str, target: str, keywords: Sequence[str],
    confirmed: DataFrame, excluded_classes: Sequence[str], confirm_words: Sequence[str], unclear_words: Sequence[str],
) -> DataFrame:
    """Members proposed for a class by keyword, with a status for the reviewer."""
    mark = confirmed.select(key).distinct().withColumn("_ok", F.lit(True))
    j = df.join(mark, key, "left").where(F.col("_ok").isNotNull() | tx.contains_any(F.col(col), keywords))
    status = (
        F.when(F.col("_ok").isNotNull(), "override")
        .when(F.col(category).isin(list(excluded_classes)), "excluded by design")
        .when(tx.contains_any(F.col(col), confirm_words), "confirm")
        .when(tx.contains_any(F.col(col), unclear_words), "ambiguous")
        .otherwise("needs review")
    )
    j = j.withColumn("status", status)
    proposed = F.when(F.col("status").isin("override", "confirm"), target).when(F.col("status") == "ambiguous", target + "?")
    return j.select(key, col, category, proposed.alias("proposed_class"), "status")


def merge_class(df: DataFrame, category: str, subclass: str, moves: Mapping[str, str]) -> DataFrame:
    """Move classes into others; the old class name becomes the subclass."""
    new = F.col(category)
    for old, target in moves.items():
        new = F.when(F.col(category) == old, F.lit(target)).otherwise(new)
    moved = F.col(category).isin(list(moves))
    return df.withColumns({subclass: F.when(moved, F.col(category)).otherwise(F.col(subclass)), category: new})


def droppable(classes: DataFrame, col: str, references: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Classes with their reference counts; only unreferenced ones may go."""
    refs = reduce(DataFrame.union, [df.select(F.col(c).alias(col)) for df, c in references])
    n = refs.groupBy(col).agg(F.count(F.lit(1)).alias("n_references"))
    return classes.join(n, col, "left").withColumn("n_references", F.coalesce("n_references", F.lit(0)).cast("bigint")).withColumn(
        "can_drop", F.col("n_references") == 0
    )


def impact(ids: DataFrame, key: str, dependents: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """What deleting each id would touch: dependents per kind, zero included."""
    parts = []
    for kind, (df, ref) in dependents.items():
        n = df.groupBy(F.col(ref).alias(key)).agg(F.count(F.lit(1)).alias("n_dependents"))
        parts.append(ids.join(n, key, "left").select(key, F.lit(kind).alias("kind"), F.coalesce("n_dependents", F.lit(0)).alias("n_dependents")))
    return reduce(DataFrame.unionByName, parts)


def sync_pairs(used: DataFrame, listed: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Changes that make the list equal to the pairs in use."""
    filled = reduce(lambda a, b: a & b, [~tx.is_blank(F.col(c)) for c in cols])
    u, l = used.where(filled).select(*cols), listed.select(*cols)
    return u.subtract(l).withColumn("action", F.lit("add")).unionByName(
        l.subtract(u).withColumn("action", F.lit("remove"))
    )


def derive_attr(df: DataFrame, key: str, name: str, col: str, lookup: DataFrame, lookup_name: str, lookup_value: str) -> DataFrame:
    """Attribute from a lookup by normalized name: changed rows only."""
    l = lookup.groupBy(tx.match_key(F.col(lookup_name)).alias("_k")).agg(F.min(lookup_value).alias("new_value"))
    return (
        df.withColumn("_k", tx.match_key(F.col(name)))
        .join(l, "_k")
        .where(~F.col(col).eqNullSafe(F.col("new_value")) & ~tx.is_blank(F.col("new_value")))
        .select(key, F.col(col).alias("old_value"), "new_value")
    )
