"""Resolution of free-text names to organizations, and pairing of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.contain import MIN_LENGTH, contained, terms_in_texts, too_short
from rosterloom.functions.joins import shuffled
from rosterloom.functions.similar import nearest
from rosterloom.functions.skew import carry
from rosterloom.session import durable
from rosterloom.functions.text import EMAIL, PHONE_RUN, clean, emails_in, folded, has_email


def match_exact(a: DataFrame, a_key: str, dictionary: DataFrame, d_id: str, d_key: str) -> DataFrame:
    """``a`` with the smallest dictionary id of its exact key (null if none)."""
    ids = dictionary.groupBy(F.col(d_key).alias(a_key)).agg(F.min(d_id).alias(d_id))
    return a.join(ids, a_key, "left")


def match_contains(keys: DataFrame, key: str, dictionary: DataFrame, d_id: str, d_key: str) -> DataFrame:
    """Distinct keys with the dictionary name of closest length that contains the
    key or is contained in it (both at least four characters); ties to the
    smallest id."""
    # both distinct sides are read several times: settle them once
    keys = durable(keys.select(key).distinct())
    names = durable(dictionary.groupBy(F.col(d_key).alias("_name")).agg(F.min(d_id).alias(d_id)))
    inside = contained(keys, key, names, "_name")
    around = contained(names, "_name", keys, key).select(key, "_name")
    pairs = inside.unionByName(around).join(shuffled(names), "_name")
    gap = F.abs(F.length(key) - F.length("_name"))
    best = F.min(F.struct(gap.alias("gap"), F.col(d_id), F.col("_name").alias("name"))).alias("b")
    return pairs.groupBy(key).agg(best).select(key, f"b.{d_id}", "b.name", "b.gap")


def match_station(
    a: DataFrame, key: str, children: DataFrame, parents: DataFrame, d_id: str, d_key: str
) -> DataFrame:
    """Organization of a free-text station, with the tier that settled it."""
    keys = durable(a.select(key).distinct())
    tiers = []
    for tier, (kind, names) in enumerate(
        (("exact", children), ("exact", parents), ("contains", children), ("contains", parents)), 1
    ):
        if kind == "exact":
            hit = match_exact(keys, key, names, d_id, d_key).where(F.col(d_id).isNotNull()).select(key, d_id)
        else:
            hit = match_contains(keys, key, names, d_id, d_key).select(key, d_id)
        tiers.append(hit.withColumn("tier", F.lit(tier)))
    hits = tiers[0].unionByName(tiers[1]).unionByName(tiers[2]).unionByName(tiers[3])
    best = hits.groupBy(key).agg(F.min(F.struct("tier", d_id)).alias("b")).select(key, f"b.{d_id}", "b.tier")
    return a.join(best, key, "left").withColumn(
        "tier",
        F.when(F.col("tier") == 1, "child exact").when(F.col("tier") == 2, "parent exact")
        .when(F.col("tier") == 3, "child contains").when(F.col("tier") == 4, "parent contains").otherwise("none"),
    )


def longest_name_in(texts: DataFrame, text: str, dictionary: DataFrame, name: str, id_col: str | None = None) -> DataFrame:
    """Longest dictionary name inside each text (ties by name).

    Short texts are keyed by themselves; long ones by ``id_col``.
    """
    if id_col is None:
        key, pairs = text, contained(texts, text, dictionary, name, min_length=1)
    else:
        key, pairs = id_col, terms_in_texts(texts, id_col, text, dictionary, name)
    order = F.struct(-F.length(name), F.col(name))
    return pairs.groupBy(key).agg(F.min_by(name, order).alias(name))


def assign_org(
    people: DataFrame, orgs: DataFrame, overrides: DataFrame, name: str = "person_name", title: str = "title"
) -> DataFrame:
    """Organization of each person by a cascade, with the reason.

    valid id; override by name; organization name inside the title; if the name
    is shared with a person who has a valid id, review; the parent id; review.
    """
    valid = orgs.select(F.col("org_id").alias("_valid")).distinct()
    o = overrides.groupBy(name).agg(F.min("org_id").alias("_override"))
    named = orgs.select(F.lower("org_name").alias("_org_key"), "org_id").groupBy("_org_key").agg(F.min("org_id").alias("_titled"))
    base = people.withColumn("_title", F.lower(title))
    in_title = longest_name_in(base.select("_title").distinct(), "_title", named, "_org_key").join(named, "_org_key")
    base = base.join(valid, F.col("org_id") == F.col("_valid"), "left")
    shared = base.where(F.col("_valid").isNotNull()).select(name).distinct().withColumn("_shared", F.lit(True))
    parent = valid.select(F.col("_valid").alias("_parent"))
    j = (
        base.join(o, name, "left")
        .join(in_title.select("_title", "_titled"), "_title", "left")
        .join(shared, name, "left")
        .join(parent, F.col("parent_id") == F.col("_parent"), "left")
    )
    steps = [
        (F.col("_valid").isNotNull(), F.col("_valid"), "valid id"),
        (F.col("_override").isNotNull(), F.col("_override"), "override"),
        (F.col("_titled").isNotNull(), F.col("_titled"), "name in title"),
        (F.col("_shared").isNotNull(), F.lit(None), "review: shared name"),
        (F.col("_parent").isNotNull(), F.col("_parent"), "parent"),
    ]
    org, why = F.when(F.lit(False), F.lit(None)), F.when(F.lit(False), "")
    for test, value, reason in steps:
        org, why = org.when(test, value), why.when(test, reason)
    return j.select(
        *[c for c in people.columns if c not in ("org_id",)],
        org.cast("bigint").alias("org_id"),
        why.otherwise("review: nothing settles it").alias("reason"),
    )


def resolve_text_vs_id(df: DataFrame, text: str, id_col: str, orgs: DataFrame) -> DataFrame:
    """The organization a row means when text and id disagree: exact text wins."""
    by_name = orgs.groupBy(F.lower("org_name").alias("_k")).agg(F.min("org_id").alias("_by_text"))
    by_id = orgs.select(F.col("org_id").alias("_by_id")).distinct()
    j = df.join(by_name, F.lower(clean(F.col(text))) == F.col("_k"), "left").join(
        by_id, F.col(id_col) == F.col("_by_id"), "left"
    )
    status = (
        F.when(F.col("_by_text").isNotNull() & F.col("_by_text").eqNullSafe(F.col("_by_id")), "agree")
        .when(F.col("_by_text").isNotNull(), "text wins")
        .when(F.col("_by_id").isNotNull(), "id kept")
        .otherwise("review")
    )
    return j.withColumn("resolved_org_id", F.coalesce("_by_text", "_by_id")).withColumn(
        "resolution", status
    ).drop("_k", "_by_text", "_by_id")


def ambiguous_keys(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Rows with a blank id whose key also occurs with an id."""
    known = df.where(F.col(id_col).isNotNull()).select(key).distinct()
    return df.where(F.col(id_col).isNull()).join(known, key, "left_semi")


def expand_children(orgs: DataFrame, matched: DataFrame) -> DataFrame:
    """Ids of the matched organizations and their direct children."""
    ids = matched.select("org_id").distinct()
    children = orgs.join(ids.select(F.col("org_id").alias("parent_id")), "parent_id", "left_semi").select("org_id")
    return ids.union(children).distinct()


def with_dependents(df: DataFrame, key: str, child: DataFrame, child_key: str) -> DataFrame:
    """Add ``has_dependents`` by existence in the child table."""
    used = child.select(F.col(child_key).alias(key)).distinct().withColumn("_d", F.lit(True))
    return df.join(used, key, "left").withColumn("has_dependents", F.coalesce("_d", F.lit(False))).drop("_d")


def relocate_by_content(rows: DataFrame, key: str, phone: str, email: str, cells: DataFrame) -> DataFrame:
    """Rows whose phone column holds an email (or the reverse), located in the
    source by that content and moved to its station if there is exactly one.

    ``cells`` has (station, cell).
    """
    misfit = F.when(has_email(F.col(phone)), F.lower(F.regexp_extract(phone, EMAIL, 0))).when(
        F.col(email).rlike(PHONE_RUN) & ~F.col(email).contains("@"), F.regexp_extract(email, PHONE_RUN, 0)
    )
    shifted = rows.withColumn("anchor", misfit).where(F.col("anchor").isNotNull())
    email_hits = emails_in(F.lower("cell"))
    phone_hits = F.regexp_extract_all("cell", F.lit(f"({PHONE_RUN})"), F.lit(1))
    anchors = cells.select("station", F.explode(F.array_union(email_hits, phone_hits)).alias("anchor"))
    places = anchors.groupBy("anchor").agg(F.min("station").alias("_lo"), F.max("station").alias("_hi"))
    j = shifted.join(places, "anchor", "left")
    status = F.when(F.col("_lo").isNull(), "not found").when(F.col("_lo") == F.col("_hi"), "relocated").otherwise("review: several stations")
    return j.select(
        key, "anchor", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("station"), status.alias("status")
    )


def pair_occurrences(a: DataFrame, b: DataFrame, key: str, title: str, a_id: str, b_id: str, has_contact: Column) -> DataFrame:
    """Pair repeated names: by occurrence, else by title, else the only row with
    contacts, else as far as the rows go.  One row per ``a`` row with a status."""
    an = carry(a.select(key, title, a_id), [key], [a_id], number="_n")
    bn = carry(b.select(key, title, b_id, has_contact.alias("_c")), [key], [b_id], number="_n")
    bn = carry(bn, [key, title], [b_id], number="_tn")
    an, bn = durable(an), durable(bn)  # read by several steps below
    a_count = an.groupBy(key).agg(F.count(F.lit(1)).alias("_ca"))
    b_stat = bn.groupBy(key).agg(
        F.count(F.lit(1)).alias("_cb"), F.min(b_id).alias("_b_first"),
        F.count_if("_c").alias("_cc"), F.min(F.when(F.col("_c"), F.col(b_id))).alias("_b_contact"),
    )
    t_stat = bn.groupBy(key, title).agg(F.count(F.lit(1)).alias("_ct"), F.min(b_id).alias("_t_first"))
    by_no = bn.select(key, "_n", F.col(b_id).alias("_b_no"))
    by_title = bn.select(key, title, F.col("_tn").alias("_n"), F.col(b_id).alias("_b_title"))
    j = (
        an.join(a_count, key).join(b_stat, key, "left").join(t_stat, [key, title], "left")
        .join(by_no, [key, "_n"], "left").join(by_title, [key, title, "_n"], "left")
    )
    steps = [
        (F.col("_cb").isNull(), F.lit(None), "missing"),
        (F.col("_cb") == 1, F.col("_b_first"), "unique-name"),
        (F.col("_cb") == F.col("_ca"), F.col("_b_no"), "name-occurrence"),
        (F.col("_ct") == F.col("_ca"), F.col("_b_title"), "title-occurrence"),
        (F.col("_ct") == 1, F.col("_t_first"), "name-and-title"),
        (F.col("_cc") == 1, F.col("_b_contact"), "only-contact-row"),
        (F.col("_b_no").isNotNull(), F.col("_b_no"), "partial-occurrence"),
    ]
    pick, status = F.when(F.lit(False), F.lit(None)), F.when(F.lit(False), "")
    for test, value, label in steps:
        pick, status = pick.when(test, value), status.when(test, label)
    return j.select(
        a_id, key, pick.otherwise(F.col("_b_first")).alias(b_id), status.otherwise("ambiguous-first").alias("match_status")
    )


def fuzzy_candidates(
    a: DataFrame, a_id: str, b: DataFrame, b_id: str, name: str, block: str, threshold: float = 0.82, blocks: bool = False
) -> DataFrame:
    """Most similar name of ``b`` in the same block for each row of ``a``, by edits or by longest matching ``blocks``."""
    best = nearest(
        a.withColumn("_k", folded(F.col(name))), "_k", b.withColumn("_k", folded(F.col(name))), "_k", [block], threshold, blocks
    )
    ids = b.withColumn("b_name", folded(F.col(name))).groupBy(block, "b_name").agg(F.min(b_id).alias(b_id))
    return (
        a.select(a_id, block, folded(F.col(name)).alias("a_name"))
        .join(shuffled(best), [block, "a_name"])
        .join(shuffled(ids), [block, "b_name"])
        .select(a_id, block, "a_name", b_id, "b_name", "similarity")
    )


def short_names(df: DataFrame, name: str, min_length: int = MIN_LENGTH) -> DataFrame:
    """Distinct names that the containment joins leave out because they are too short."""
    return too_short(df.select(name).distinct(), F.col(name), min_length)


def containment_pairs(df: DataFrame, name: str, min_length: int = MIN_LENGTH) -> DataFrame:
    """Pairs of distinct names where one contains the other; the longer is kept."""
    other = df.select(F.col(name).alias("drop_name"))
    pairs = contained(df.select(F.col(name).alias("keep_name")), "keep_name", other, "drop_name", min_length)
    return pairs.where(F.col("keep_name") != F.col("drop_name"))


def enrich(people: DataFrame, orgs: DataFrame) -> DataFrame:
    """Listing with organization and parent names where they exist."""
    names = orgs.select("org_id", "org_name", "parent_id")
    parents = orgs.select(F.col("org_id").alias("parent_id"), F.col("org_name").alias("parent_name"))
    return people.join(names, "org_id", "left").join(parents, "parent_id", "left")


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row of each key, combined on the map side."""
    rest = [c for c in df.columns if c != key and c not in order]
    first = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("f"))
    return first.select(key, *[f"f.{c}" for c in (*order, *rest)])


def rollup_parent(df: DataFrame, tree: DataFrame) -> DataFrame:
    """Records counted under the parent organization (top-level ones under themselves)."""
    up = tree.select("org_id", F.coalesce("parent_id", "org_id").alias("top_id"))
    per_org = df.groupBy("org_id").agg(F.count(F.lit(1)).alias("n"))
    return per_org.join(up, "org_id").groupBy("top_id").agg(
        F.sum("n").cast("bigint").alias("n_records"), F.count(F.lit(1)).alias("n_orgs")
    )
