"""Duplicates and merges.

Groups are described by counts and by their lowest id instead of lists of
siblings, so a group of any size stays rows, and counting combines map-side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import text as tx
from rosterloom.functions.contain import too_short
from rosterloom.functions.joins import join_on
from rosterloom.functions.rules import Rule, first_match
from rosterloom.functions.similar import nearest


def _null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[l].eqNullSafe(right[r]) for l, r in pairs])


def dup_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def dup_span(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Lowest and highest id of each duplicate group; all but the lowest would go."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min(id_col).alias("keep_id"), F.max(id_col).alias("last_id"))
        .where("n_rows > 1")
        .withColumn("n_dropped", F.col("n_rows") - 1)
    )


def dup_rows(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Rows of duplicate groups with the group's lowest id, its size and one sibling.

    ``keep_id`` identifies the group, so all siblings are one equi join away.
    """
    groups = dup_span(df, keys, id_col)
    names = [(k, f"_g_{k}") for k in keys]
    g = groups.select(*[F.col(k).alias(n) for k, n in names], "n_rows", "keep_id", "last_id")
    sibling = F.when(F.col(id_col) == F.col("keep_id"), F.col("last_id")).otherwise(F.col("keep_id"))
    return df.join(g, _null_safe(df, g, names)).select(
        *df.columns, "keep_id", "n_rows", sibling.alias("sibling_id")
    )


def exact_dups(df: DataFrame, evidence: Sequence[str], id_col: str) -> DataFrame:
    """Rows to delete: equal in all evidence (nulls too) to a row with a lower id."""
    return dup_rows(df, evidence, id_col).where(F.col(id_col) > F.col("keep_id")).select(
        id_col, "keep_id", *evidence
    )


def near_dups(df: DataFrame, deleted: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Survivors that still share name and group: different evidence, for review."""
    left = df.join(deleted.select(id_col), id_col, "left_anti")
    return join_on(left, dup_keys(left, keys), keys)


def orphan_dups(df: DataFrame, key: str, ref: str, id_col: str) -> DataFrame:
    """Rows without a reference whose key repeats: droppable if the key has exactly
    one row with a reference and this is the only one without."""
    n = df.groupBy(key).agg(
        F.count(ref).alias("n_valid"), F.count_if(F.col(ref).isNull()).alias("n_orphan")
    ).where("n_orphan > 0 AND n_valid + n_orphan > 1")
    action = (
        F.when((F.col("n_valid") == 1) & (F.col("n_orphan") == 1), "drop orphan")
        .when(F.col("n_valid") == 0, "review: no valid row")
        .when(F.col("n_valid") > 1, "review: several valid rows")
        .otherwise("review: several orphans")
    )
    return df.where(F.col(ref).isNull()).join(n, key).select(id_col, key, "n_valid", "n_orphan", action.alias("action"))


def shared_values(contacts: DataFrame, owner: str, text: str, min_digits: int = 8, email: str | None = None) -> DataFrame:
    """Numbers and emails held by more than one owner: one row per value and owner.

    ``email`` is a column of addresses: digits inside one are no number of its owner.
    """
    mails = tx.email_set(F.col(text)) if email is None else tx.email_set(F.col(text), F.col(email))
    values = F.array_union(tx.phone_set(F.col(text), min_digits=min_digits), mails)
    held = contacts.select(owner, F.explode(values).alias("value")).distinct()
    shared = held.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners")).where("n_owners > 1")
    return held.join(shared, "value")


def apply_merge(parents: DataFrame, children: DataFrame, merges: DataFrame, key: str, fill: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Merge losers into winners: (parents, children).

    Children follow the map, blanks of a winner are filled from its losers (lowest
    id first), losers go.  A loser whose winner is missing or is itself a loser
    stays with its children, marked as refused.
    """
    ids = parents.select(F.col(key).alias("winner"))
    losers = merges.select(F.col("loser").alias("winner"))
    usable = merges.join(ids, "winner", "left_semi").join(losers, "winner", "left_anti")
    usable = usable.groupBy("loser").agg(F.min("winner").alias("winner"))
    lost = parents.join(usable.withColumnRenamed("loser", key), key)
    donor = lambda c: F.min(F.when(~tx.is_blank(F.col(c)), F.struct(F.col(key), F.col(c)))).alias(f"_{c}")
    gifts = lost.groupBy(F.col("winner").alias(key)).agg(*[donor(c) for c in fill])
    kept = parents.join(usable.select(F.col("loser").alias(key)), key, "left_anti").join(gifts, key, "left")
    refused = merges.select(F.col("loser").alias(key)).distinct().withColumn("refused", F.lit(True))
    filled = [F.when(tx.is_blank(F.col(c)), F.coalesce(f"_{c}.{c}", c)).otherwise(F.col(c)).alias(c) for c in fill]
    rest = [c for c in parents.columns if c not in fill]
    new_parents = kept.join(refused, key, "left").select(
        *rest, *filled, F.coalesce("refused", F.lit(False)).alias("refused")
    )
    moved = children.join(usable.withColumnRenamed("loser", key), key, "left")
    new_children = moved.withColumn(key, F.coalesce("winner", key)).drop("winner")
    return new_parents, new_children


def backfill(
    a: DataFrame, b: DataFrame, block: str, name: str, title: str, fields: Sequence[str], a_id: str, b_id: str, threshold: float = 0.82,
    min_length: int = 4, blocks: bool = False,
) -> DataFrame:
    """Values for blanks of ``a`` from a duplicate in ``b`` of the same block.

    HIGH only for one exact namesake without a title conflict; several, conflicting
    or merely similar names (by edits, or by longest matching ``blocks``) need review.  Names under ``min_length``
    are not compared: ``short_names`` returns those without an exact namesake.
    """
    key = tx.match_key(F.col(name), "person")
    blank_any = reduce(lambda x, y: x | y, [tx.is_blank(F.col(f)) for f in fields])
    need = a.where(blank_any).withColumn("_k", key)
    have = b.withColumn("_k", key)
    donors = have.groupBy(block, "_k").agg(
        F.min(F.struct(F.col(b_id).alias("donor_id"), *[F.col(f).alias(f"d_{f}") for f in fields])).alias("d"),
        F.count(F.lit(1)).alias("n_candidates"),
        F.min(F.nullif(tx.folded(F.col(title)), F.lit(""))).alias("_t_lo"),
        F.max(F.nullif(tx.folded(F.col(title)), F.lit(""))).alias("_t_hi"),
    )
    exact = join_on(need, donors, [block, "_k"]).withColumn("is_exact", F.lit(True))
    rest = join_on(need, donors, [block, "_k"], "left_anti").where(F.length("_k") >= min_length)
    in_block = F.struct(block).alias(block)  # a struct of null equals another one
    close = nearest(rest.select(in_block, "_k"), "_k", have.select(in_block, "_k"), "_k", [block], threshold, blocks)
    close = close.select(f"{block}.{block}", F.col("a_name").alias("_k"), F.col("b_name").alias("_bk"))
    fuzzy = join_on(join_on(rest, close, [block, "_k"]), donors.withColumnRenamed("_k", "_bk"), [block, "_bk"]).withColumn("is_exact", F.lit(False)).drop("_bk")
    both = exact.unionByName(fuzzy)
    t = tx.folded(F.col(title))
    conflict = (t != "") & ((F.col("_t_lo") != t) | (F.col("_t_hi") != t))
    high = F.col("is_exact") & (F.col("n_candidates") == 1) & ~F.coalesce(conflict, F.lit(False))
    cells = [
        F.when(
            tx.is_blank(F.col(f)) & ~tx.is_blank(F.col(f"d.d_{f}")),
            F.struct(F.lit(f).alias("field"), F.col(f"d.d_{f}").alias("proposed_value")),
        )
        for f in fields
    ]
    return both.select(
        a_id, block, F.col("d.donor_id").alias("donor_id"),
        F.when(high, "HIGH").otherwise("NEEDS_REVIEW").alias("confidence"), "is_exact",
        F.inline(F.array_compact(F.array(*cells))),
    )


def short_names(
    a: DataFrame, b: DataFrame, block: str, name: str, fields: Sequence[str], a_id: str, min_length: int = 4
) -> DataFrame:
    """The rows of ``a`` with blanks that ``backfill`` leaves out: no exact namesake, and a name too short to compare."""
    key = tx.match_key(F.col(name), "person")
    blank_any = reduce(lambda x, y: x | y, [tx.is_blank(F.col(f)) for f in fields])
    need = too_short(a.where(blank_any).withColumn("_k", key), F.col("_k"), min_length)
    exact = b.select(block, key.alias("_k")).distinct()
    return join_on(need, exact, [block, "_k"], "left_anti").select(a_id, block, name, "status")


def relabel_by_signal(df: DataFrame, key: str, id_col: str, label: str, rules: Sequence[Rule]) -> DataFrame:
    """Rows sharing a label that an evidence column tells apart: proposed labels."""
    groups = dup_keys(df.select(key), [key])
    new = first_match(list(rules))
    return df.join(groups, key).select(
        id_col, key, F.col(label).alias("current_label"), new.alias("proposed_label"),
        F.when(new.isNull(), "needs review").otherwise("rename").alias("action"),
    )
