"""Ranking, ordering and top-k listings.

"Best row per organization" is an aggregate, not a window: it combines on the map
side, so an organization with a third of all people costs no more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.rules import Tiers
from rosterloom.functions.skew import numbered_by_range

# Title groups from most to least senior.
DEFAULT_TIERS = Tiers((
    ("chairman",),
    ("chairman & managing director", "cmd"),
    ("managing director", "md"),
    ("director",),
    ("chief executive officer", "ceo"),
    ("executive director", "ed"),
    ("chief general manager", "cgm"),
    ("additional general manager", "agm"),
    ("general manager", "gm"),
    ("deputy general manager", "dgm"),
    ("senior general manager", "sgm"),
    ("chief engineer", "ce"),
    ("additional chief engineer", "ace"),
    ("superintending engineer", "se"),
    ("executive engineer", "ee"),
    ("deputy chief engineer",),
    ("plant head",),
    ("station head",),
    ("head",),
    ("senior manager",),
    ("manager",),
    ("deputy manager",),
    ("assistant manager",),
    ("senior engineer",),
    ("engineer",),
    ("assistant engineer",),
    ("executive",),
    ("officer",),
    ("supervisor",),
    ("technician",),
    ("operator",),
))


def rank_titles(df: DataFrame, col: str, tiers: Tiers = DEFAULT_TIERS) -> DataFrame:
    """Add ``title_rank`` (0 is most senior, unranked last) and ``title_phrase``."""
    return df.withColumn("title_rank", tiers.rank(F.col(col))).withColumn(
        "title_phrase", tiers.phrase(F.col(col))
    )


def resolve_heads(
    people: DataFrame, orgs: DataFrame, tiers: Tiers = DEFAULT_TIERS, respect_exclusion: bool = True
) -> DataFrame:
    """One head per organization: (org_id, person_id, title_rank).

    Only ACTIVE people count; a flagged person wins, then the best title, then
    the lowest id.  Excluded organizations have no head.
    """
    live = people.where((F.col("status") == "ACTIVE") & F.col("org_id").isNotNull()).select(
        "org_id", "person_id", F.when(F.col("flagged"), 0).otherwise(1).alias("unflagged"), tiers.rank(F.col("title")).alias("title_rank")
    )
    # lowest id per rank first: a plain hash aggregate that leaves a few rows per organization
    firsts = live.groupBy("org_id", "unflagged", "title_rank").agg(F.min("person_id").alias("person_id"))
    priority = F.when(F.col("unflagged") == 1, F.col("title_rank")).otherwise(0)
    choice = F.struct("unflagged", priority.alias("priority"), "person_id", "title_rank")
    best = firsts.groupBy("org_id").agg(F.min(choice).alias("best"))
    if respect_exclusion:
        best = best.join(orgs.where(F.col("head_excluded")), "org_id", "left_anti")
    return best.select("org_id", "best.person_id", "best.title_rank")


def resolve_heads_scored(
    people: DataFrame, tiers: Sequence[tuple[int, Sequence[str]]], excluded: Sequence[str]
) -> DataFrame:
    """Head by highest score, first tier with a contained phrase; score 0 is no head."""
    low = F.lower(F.trim("title"))
    score = F.when(F.coalesce(low, F.lit("")) == "", 0)
    for word in excluded:
        score = score.when(low.contains(word), 0)
    for points, words in tiers:
        for word in words:
            score = score.when(low.contains(word), points)
    scored = people.select("org_id", "person_id", score.otherwise(0).alias("score")).where("score > 0")
    firsts = scored.groupBy("org_id", "score").agg(F.min("person_id").alias("person_id"))
    best = firsts.groupBy("org_id").agg(F.max("score").alias("score"), F.max_by("person_id", "score").alias("person_id"))
    return best.select("org_id", "person_id", "score")


def pinned_order(col: str, pins: Sequence[str]) -> list[Column]:
    """Sort columns: pinned names first in their order, the rest by lower case."""
    at = F.array_position(F.array(*[F.lit(p) for p in pins]), F.col(col))
    pin = F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(len(pins) + 1)
    return [pin, F.when(pin > len(pins), F.lower(col))]


def heads_first(people: DataFrame, heads: DataFrame, n: int) -> DataFrame:
    """First ``n`` people of the listing (its page size): heads, then organization, name, id."""
    marks = heads.select("person_id", F.lit(True).alias("is_head"))
    return (
        people.join(marks, "person_id", "left")
        .withColumn("is_head", F.coalesce("is_head", F.lit(False)))
        .orderBy(F.desc("is_head"), "org_name", "person_name", "person_id")
        .limit(n)
    )


def suggest(
    kinds: Sequence[tuple[DataFrame, str, str, int]], term: str, total: int
) -> DataFrame:
    """Autocomplete over (table, column, kind, cap) in order.

    Per kind: names containing the term, prefix matches first, then by name, up
    to the cap; a value appears once, from its earliest kind; ``total`` rows.
    Ranking happens before the caps, and each cap is a distributed top-k.
    """
    term = term.lower()
    out = None
    for i, (df, col, kind, cap) in enumerate(kinds):
        hits = (
            df.select(F.trim(col).alias("value"))
            .where(F.lower("value").contains(term))
            .distinct()
            .withColumn("tier", F.when(F.lower("value").startswith(term), 0).otherwise(1))
            .orderBy("tier", "value")
            .limit(cap)
            .select(F.lit(i).alias("kind_no"), F.lit(kind).alias("kind"), "tier", "value")
        )
        out = hits if out is None else out.unionByName(hits)
    # at most the sum of the caps is left from here on
    once = out.groupBy(F.lower("value").alias("_v")).agg(
        F.min(F.struct("kind_no", "tier", "value", "kind")).alias("s")
    )
    return once.select("s.kind", "s.value", "s.tier", "s.kind_no").orderBy("kind_no", "tier", "value").limit(total).select(
        "kind", "value", "tier"
    )


def top_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), key).limit(n)
    )


def numbered(df: DataFrame, section: Sequence[str], order: Sequence[str], out: str = "serial") -> DataFrame:
    """Serial numbers within each section of an ordered listing."""
    return numbered_by_range(df, section, order, out)


def page(df: DataFrame, order: Sequence[str | Column], k: int, n: int, shallow: int = 100_000) -> DataFrame:
    """Page ``k`` (1-based) of ``n`` rows, with the total row count on each row.

    A page that ends within ``shallow`` rows is a distributed top-k.  For a deeper one the rows are
    numbered by range, so that no task is handed all rows before it.  Rows equal in ``order`` go by a hash of
    all their columns, so both give the same rows.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    order = [*order, F.xxhash64(*df.columns)]
    if k * n <= shallow:
        rows = df.orderBy(*order).offset((k - 1) * n).limit(n)
    else:
        rows = numbered_by_range(df, [], order, "_no").where(F.col("_no").between((k - 1) * n + 1, k * n)).drop("_no")
    return rows.withColumn("total_rows", total)
