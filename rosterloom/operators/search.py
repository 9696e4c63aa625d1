"""Keyword search and grouped browsing, each one plan instead of a query per row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import text as tx
from rosterloom.functions.contain import terms_in_texts

from .rank import heads_first, pinned_order
from .resolve import expand_children
from .standardize import row_kind


def text_match(q: str, cols: Sequence[str], email: str | None = None) -> Column:
    """Case-insensitive containment in any column; email only for a term with "@"."""
    cols = [*cols, *([email] if email and "@" in q else [])]
    term = q.lower()
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(term), F.lit(False)) for c in cols])


def _listing(people: DataFrame, orgs: DataFrame) -> DataFrame:
    parents = orgs.select(F.col("org_id").alias("parent_id"), F.col("org_name").alias("parent_name"))
    named = orgs.select("org_id", "org_name", "parent_id", "state").join(parents, "parent_id", "left")
    return people.join(named, "org_id", "left")


PERSON_COLS = ("person_name", "title", "mobile", "office", "dept", "status", "org_name", "state", "parent_name")


def search_people(people: DataFrame, orgs: DataFrame, q: str) -> DataFrame:
    return _listing(people, orgs).where(text_match(q, PERSON_COLS, "email"))


def search_places(places: DataFrame, orgs: DataFrame, q: str) -> DataFrame:
    """Places matching by their own text or by their organization's state."""
    region = orgs.where(text_match(q, ["state"])).select("org_id").distinct().withColumn("_in", F.lit(True))
    own = text_match(q, ["label", "phone", "station", "category"], "email")
    return places.join(region, "org_id", "left").where(own | F.col("_in").isNotNull()).drop("_in")


def _place_kind(places: DataFrame) -> DataFrame:
    return row_kind(
        places, ["category"],
        [("control_room", lambda c: tx.contains_any(c, ["control room"])), ("switchyard", lambda c: tx.contains_any(c, ["switchyard"]))],
    ).withColumn("kind", F.when(F.col("kind") == "person", "other").otherwise(F.col("kind")))


def browse_keyword(orgs: DataFrame, people: DataFrame, places: DataFrame, heads: DataFrame, q: str, cap: int | None = None) -> DataFrame:
    """Grouped result rows (org_id, section, record_id, record_name).

    Organizations whose name matches bring their children; key people are listed if
    in that subtree or matching; places are split by kind.  Children without any
    content keep an empty row.  With a ``cap`` only so many people are listed, heads
    first, and a row of the section ``people left out`` holds the number of the others.
    """
    matched = orgs.where(text_match(q, ["org_name"])).select("org_id")
    subtree = expand_children(orgs, matched)
    inside = subtree.withColumn("_in", F.lit(True))
    listed = _listing(people.where("is_kmp AND status = 'ACTIVE'"), orgs).join(inside, "org_id", "left")
    listed = listed.where(F.col("_in").isNotNull() | text_match(q, PERSON_COLS, "email"))
    hidden = None
    if cap is not None:
        hidden = listed.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).select(
            F.lit(None).cast("bigint").alias("org_id"), F.lit("people left out").alias("section"),
            (F.col("n") - cap).cast("bigint").alias("record_id"), F.lit(None).cast("string").alias("record_name"),
        )
        listed = heads_first(listed, heads, cap)
    shown = listed.select(
        "org_id", F.lit("person").alias("section"), F.col("person_id").alias("record_id"), F.col("person_name").alias("record_name")
    )
    spots = places.join(inside, "org_id", "left").where(F.col("_in").isNotNull() | text_match(q, ["label", "phone"], "email"))
    spots = _place_kind(spots).select(
        "org_id", F.col("kind").alias("section"), F.col("place_id").alias("record_id"), F.col("label").alias("record_name")
    )
    content = shown.unionByName(spots)
    grouped = content.where("section <> 'other'").select("org_id").distinct()
    children = orgs.join(matched.select(F.col("org_id").alias("parent_id")), "parent_id", "left_semi").select("org_id")
    empty = children.join(grouped, "org_id", "left_anti").select(
        "org_id", F.lit("empty").alias("section"), F.lit(None).cast("bigint").alias("record_id"), F.lit(None).cast("string").alias("record_name")
    )
    rows = content.unionByName(empty)
    return rows if hidden is None else rows.unionByName(hidden)


def browse_category(orgs: DataFrame, people: DataFrame, places: DataFrame, category: str, pins: Sequence[str]) -> DataFrame:
    """Every organization of a category with its counts, also without any contact.

    Counts are aggregated before the join.  Sorted by subcategory, pins, name.
    """
    p = people.where("is_kmp AND status = 'ACTIVE'").groupBy("org_id").agg(
        F.count(F.lit(1)).alias("n_people"), F.min(F.struct("person_name", "person_id"))["person_name"].alias("first_person")
    )
    k = _place_kind(places).groupBy("org_id").agg(
        *[F.count_if(F.col("kind") == n).alias(f"n_{n}") for n in ("control_room", "switchyard", "other")]
    )
    counts = ["n_people", "n_control_room", "n_switchyard", "n_other"]
    pin, name = pinned_order("org_name", pins)
    seeded = orgs.where(F.col("category") == category).select("org_id", "org_name", F.col("state").alias("subcategory"))
    return (
        seeded.join(p, "org_id", "left").join(k, "org_id", "left").na.fill(0, counts)
        .withColumns({"pin": pin.cast("bigint")})
        .orderBy("subcategory", "pin", name)
    )


def category_cards(orgs: DataFrame, people: DataFrame) -> DataFrame:
    """Organizations and active key people per category; empty categories do not occur."""
    live = people.where("is_kmp AND status = 'ACTIVE'").groupBy("org_id").agg(F.count(F.lit(1)).alias("n"))
    return orgs.join(live, "org_id", "left").groupBy("category").agg(
        F.count(F.lit(1)).alias("n_organizations"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_contacts")
    )


def facets(df: DataFrame, by: str, col: str) -> DataFrame:
    """Distinct filled values per parent, sorted."""
    return df.where(~tx.is_blank(F.col(col))).select(by, col).distinct().orderBy(by, col)


def search_roles(
    heads: DataFrame, assistants: DataFrame, orgs: DataFrame, q: str | None = None, title: str | None = None,
    category: str | None = None, state: str | None = None, status: str | None = None,
) -> DataFrame:
    """Administrative role holders: structured filters AND, text in name, title or
    any assistant's name.  Holders whose linked person left are excluded."""
    out = heads.where("role_category = 'ADMINISTRATIVE_HEAD' AND (person_id IS NULL OR person_status = 'ACTIVE')")
    if status:
        out = out.where(F.col("status") == status)
    if title:
        out = out.where(text_match(title, ["role_title"]))
    if category or state:
        scope = orgs
        if category:
            scope = scope.where(F.col("category") == category)
        if state:
            scope = scope.where(F.col("state") == state)
        out = out.join(scope.select("org_id").distinct(), "org_id", "left_semi")
    if q:
        by_assistant = assistants.where(text_match(q, ["name"])).select("head_id").distinct().withColumn("_a", F.lit(True))
        out = out.join(by_assistant, "head_id", "left").where(text_match(q, ["name", "role_title"]) | F.col("_a").isNotNull()).drop("_a")
    return out


def search_versions(versions: DataFrame, month: int | None = None, year: int | None = None, q: str | None = None) -> DataFrame:
    """Snapshots by period and text, newest first."""
    out = versions
    if month:
        out = out.where(F.col("month") == month)
    if year:
        out = out.where(F.col("year") == year)
    if q:
        out = out.where(text_match(q, ["version_number", "status"]))
    return out.orderBy(F.desc("generated_on"), F.desc("version_id"))


def token_index(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """Inverted index (token, id, hits) over the text columns."""
    tokens = F.split(F.lower(F.concat_ws(" ", *cols)), r"[^\p{L}\p{N}]+")
    return (
        df.select(id_col, F.explode(tokens).alias("token")).where("token <> ''")
        .groupBy("token", id_col).agg(F.count(F.lit(1)).alias("hits"))
    )


def search_tokens(index: DataFrame, id_col: str, words: Sequence[str], n: int) -> DataFrame:
    """Rows with most of the words, then most hits, then lowest id; first ``n``."""
    found = index.where(F.col("token").isin([w.lower() for w in words]))
    return (
        found.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_words"), F.sum("hits").alias("n_hits"))
        .orderBy(F.desc("n_words"), F.desc("n_hits"), id_col).limit(n)
    )


def search_text(df: DataFrame, id_col: str, cols: Sequence[str], q: str, n: int) -> DataFrame:
    """First ``n`` rows by id containing the text in any column."""
    return df.where(text_match(q, cols)).orderBy(id_col).limit(n)


def search_batch(texts: DataFrame, id_col: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Texts matching each of many terms, in one pass."""
    return terms_in_texts(texts, id_col, text, terms, term)
