"""Directory statistics.  Facts are aggregated before they meet, never multi-joined raw."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The status domain, used by every statistic.
STATUSES = ("ACTIVE", "INACTIVE", "TRANSFERRED", "RETIRED", "RESIGNED", "DECEASED", "ON LEAVE", "SUSPENDED")


def _name(status: str) -> str:
    return "n_" + status.lower().replace(" ", "_")


def status_by_org(people: DataFrame) -> DataFrame:
    """People per organization and status; columns add up to the total."""
    counts = [F.count_if(F.col("status") == s).alias(_name(s)) for s in STATUSES]
    other = F.count_if(~F.coalesce(F.col("status").isin(list(STATUSES)), F.lit(False))).alias("n_unknown")
    return people.groupBy("org_id").agg(F.count(F.lit(1)).alias("n_total"), *counts, other)


def org_stats(orgs: DataFrame, relations: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row counts of several relations per organization, zero included."""
    out = orgs.select("org_id", "org_name")
    for kind, (df, ref) in relations.items():
        n = df.groupBy(F.col(ref).alias("org_id")).agg(F.count(F.lit(1)).alias(f"n_{kind}"))
        out = out.join(n, "org_id", "left")
    return out.na.fill(0, [f"n_{k}" for k in relations])


def by_category(df: DataFrame, col: str, empty: str = "(none)") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(col), F.lit(empty)).alias("category")).agg(F.count(F.lit(1)).alias("n_rows"))


def category_tree(df: DataFrame, category: str, sub: str, listed: DataFrame) -> DataFrame:
    """Counts per category and subcategory with totals per category and overall.

    Listed pairs appear with zero; unlisted ones are marked; blanks form a bucket.
    ``level``: 0 pair, 1 category total, 3 grand total.
    """
    none = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("(none)"))
    used = df.groupBy(none(category).alias("category"), none(sub).alias("subcategory")).agg(F.count(F.lit(1)).alias("n"))
    pairs = listed.select(F.col(category).alias("category"), F.col(sub).alias("subcategory"), F.lit(True).alias("is_listed")).distinct()
    both = used.join(pairs, ["category", "subcategory"], "full").select(
        "category", "subcategory", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("is_listed", F.lit(False)).alias("is_listed")
    )
    return both.rollup("category", "subcategory").agg(
        F.sum("n").alias("n_rows"), F.count_if(~F.col("is_listed")).alias("n_unlisted"), F.grouping_id().alias("level")
    )


def totals(counts: Mapping[str, DataFrame]) -> DataFrame:
    """One row per dashboard figure; each table is counted on its own."""
    out = None
    for name, df in counts.items():
        one = df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("figure"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def version_stats(versions: DataFrame) -> DataFrame:
    order = F.struct("generated_on", "version_id")
    return versions.agg(
        F.count(F.lit(1)).alias("n_versions"),
        F.max_by("version_number", order).alias("latest_version"),
        F.count_if(F.col("status") == "PUBLISHED").alias("n_published"),
    )


def directory_rows(orgs: DataFrame, people: DataFrame, places: DataFrame, heads: DataFrame) -> DataFrame:
    """The sectioned directory as long rows with order keys.

    Sections per organization: people (heads first), control rooms, switchyards, other.
    """
    names = orgs.select("org_id", "org_name")
    mark = heads.select("person_id", F.lit(0).alias("_h"))
    staff = (
        people.where("status = 'ACTIVE'").join(mark, "person_id", "left").join(names, "org_id", "left")
        .select(
            F.coalesce("org_name", F.lit("Unknown")).alias("org_name"), F.lit(1).alias("section_no"), F.lit("people").alias("section"),
            F.coalesce("_h", F.lit(1)).alias("rank"), F.col("person_name").alias("name"), F.col("person_id").alias("record_id"),
            F.col("mobile").alias("phone"), "email",
        )
    )
    low = F.lower("category")
    no = F.when(low.contains("switchyard"), 3).when(low.contains("control room"), 2).otherwise(4)
    label = F.when(no == 2, "control rooms").when(no == 3, "switchyards").otherwise("other")
    spots = places.join(names, "org_id", "left").select(
        F.coalesce("org_name", F.lit("Unknown")).alias("org_name"), no.alias("section_no"), label.alias("section"),
        F.lit(0).alias("rank"), F.col("label").alias("name"), F.col("place_id").alias("record_id"), "phone", "email",
    )
    return staff.unionByName(spots)


DIRECTORY_ORDER: Sequence[str] = ("org_name", "section_no", "rank", "name", "record_id")
