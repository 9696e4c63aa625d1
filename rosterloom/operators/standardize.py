"""Standardization jobs: rows in; standardized rows and a change log out.

Every job is one projection over the scan; the log is the changed cells of the
same projection, exploded, so neither side needs a join or a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rosterloom.functions import text as tx
from rosterloom.functions.rules import Rule, first_match


@dataclass(frozen=True)
class Standardized:
    """``marked`` are the rows with ``changed``, the names of their changed columns; ``tagged`` holds rows and log of one projection."""

    rows: DataFrame
    log: DataFrame
    counts: DataFrame
    marked: DataFrame | None = None
    tagged: DataFrame | None = None


def _changes(changes: Sequence[tuple[str, Column, Column, Column | str]]) -> Column:
    """The changed cells of a row, as an array of (field, old_value, new_value, reason)."""
    cells = [
        F.when(
            ~old.eqNullSafe(new),
            F.struct(
                F.lit(name).alias("field"),
                old.cast("string").alias("old_value"),
                new.cast("string").alias("new_value"),
                (F.lit(why) if isinstance(why, str) else why).alias("reason"),
            ),
        )
        for name, old, new, why in changes
    ]
    return F.array_compact(F.array(*cells))


def change_log(
    df: DataFrame, key: str, changes: Sequence[tuple[str, Column, Column, Column | str]]
) -> DataFrame:
    """Long rows (key, field, old_value, new_value, reason) of cells that changed."""
    return df.select(key, F.inline(_changes(changes)))


def standardize(
    df: DataFrame, key: str, new: Mapping[str, Column], reason: str | Mapping[str, Column]
) -> Standardized:
    """Replace columns by expressions over the old ones."""
    why = {c: reason if isinstance(reason, str) else reason[c] for c in new}
    # the new value is a column of its own, so each test reads it instead of computing it
    both = df.withColumns({f"_new_{c}": e for c, e in new.items()})
    now = [F.col(f"_new_{c}").alias(c) if c in new else F.col(c) for c in df.columns]
    changes = [(c, F.col(c), F.col(f"_new_{c}"), why[c]) for c in new]
    rows, log = both.select(*now), change_log(both, key, changes)
    counts = log.groupBy("field", "reason").agg(F.count(F.lit(1)).alias("n_changes"))
    changed = F.array_compact(F.array(*[F.when(~old.eqNullSafe(value), F.lit(c)) for c, old, value, _ in changes]))
    # the row itself, then each of its changes
    row = F.struct(*now)
    cells = F.transform(_changes(changes), lambda x: F.struct(F.lit("log").alias("kind"), F.when(F.lit(False), row).alias("row"), x.alias("change")))
    itself = F.array(F.struct(F.lit("rows").alias("kind"), row.alias("row"), F.when(F.lit(False), _changes(changes)[0]).alias("change")))
    tagged = both.select(F.col(key).alias("_key"), F.inline(F.concat(itself, cells)))
    return Standardized(rows, log, counts, both.select(*now, changed.alias("changed")), tagged)


def land(done: Standardized, key: str, path: str) -> Standardized:
    """Write rows and log in one pass over the source, and read them back.

    One projection makes both, written partitioned by kind.  The numbers of rows and of changes are observed on the
    write: ``counts`` has them as one row, and nothing is read again for them.
    """
    spark, seen = done.rows.sparkSession, Observation()
    number = lambda kind: F.count_if(F.col("kind") == kind)
    watched = done.tagged.observe(seen, number("rows").alias("n_rows"), number("log").alias("n_changes"))
    watched.write.mode("errorifexists").partitionBy("kind").parquet(path)
    stored = spark.read.schema(done.tagged.schema).parquet(path)
    rows = stored.where("kind = 'rows'").select("row.*")
    log = stored.where("kind = 'log'").select(F.col("_key").alias(key), "change.*")
    counts = spark.createDataFrame([(seen.get.get("n_rows") or 0, seen.get.get("n_changes") or 0)], "n_rows bigint, n_changes bigint")
    return Standardized(rows, log, counts)


def clean_text(df: DataFrame, key: str, cols: Sequence[str]) -> Standardized:
    return standardize(df, key, {c: tx.clean(F.col(c)) for c in cols}, "Whitespace")


def normalize_emails(df: DataFrame, key: str, cols: Sequence[str]) -> Standardized:
    why = {
        c: F.when(F.trim(c) != F.col(c), "Whitespace").otherwise("Email lower case") for c in cols
    }
    return standardize(df, key, {c: F.lower(F.trim(c)) for c in cols}, why)


def strip_prefix(df: DataFrame, key: str, col: str, prefixes: Sequence[str] = ()) -> Standardized:
    """Drop a leading serial number, then the longest listed prefix."""
    return standardize(
        df, key, {col: tx.strip_prefixes(tx.strip_serial(F.col(col)), prefixes)}, "Numbered or site prefix"
    )


def match_keys(df: DataFrame, col: str, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """All four comparison keys of a label."""
    return df.withColumns(
        {f"key_{f}": tx.match_key(F.col(col), f, aliases) for f in ("words", "compact", "letters", "person")}
    )


def canonical_phone(df: DataFrame, col: str, mode: str = "strict") -> DataFrame:
    """Add ``national`` and ``phone_status``: ok, blank, or review."""
    number = tx.national_number(F.col(col), mode)
    status = F.when(tx.is_blank(F.col(col)), "blank").when(number.isNull(), "review").otherwise("ok")
    return df.withColumns({"national": number, "phone_status": status})


def split_phones(df: DataFrame, key: str, col: str, default_type: str) -> DataFrame:
    """Typed numbers of a free-text phone column, one row each, first-seen order.

    Text after "Fax" is fax; "Extn"/"Extension" is spelled one way; commas,
    semicolons, slashes and "or" separate numbers; parts without a digit drop.
    """
    # a value without a digit yields no number
    df = df.where(F.col(col).rlike("[0-9]")).withColumn("_v", tx.clean(F.col(col)))
    value = F.when(F.col("_v").contains("@"), F.regexp_replace("_v", tx.EMAIL, " ")).otherwise(F.col("_v"))
    value = F.regexp_replace(value, r"(?i)\b(Extension|Extn?)\b\.?\s*", "Extn. ")
    by_type = F.split(value, r"(?i)\bFax(?:\s*No\.?)?\s*:?")
    pieces = df.select(key, F.posexplode(by_type).alias("part_no", "part"))
    tokens = pieces.select(
        key, "part_no", F.posexplode(F.split("part", r"(?i)\s*(?:,|;|\bor\b|/)\s*")).alias("token_no", "token")
    )
    number = F.regexp_replace(tx.clean(F.col("token")), r"^[ .;,-]+|[ .;,-]+$", "")
    kind = F.when(F.col("part_no") > 0, "fax").otherwise(default_type)
    typed = tokens.select(key, kind.alias("phone_type"), number.alias("number"), "part_no", "token_no")
    return (
        typed.where(F.col("number").rlike("[0-9]"))
        .groupBy(key, "phone_type", "number")
        .agg(F.min(F.struct("part_no", "token_no")).alias("at"))
        .select(key, "phone_type", "number", "at.part_no", "at.token_no")
    )


def dedupe_segments(df: DataFrame, key: str, col: str) -> Standardized:
    """Remove repeated segments of a multi-valued text, keeping first-seen order."""
    parts = tx.segments(F.col(col))
    repeated = F.size(parts) > F.size(F.array_distinct(parts))
    return standardize(
        df, key, {col: F.when(repeated, tx.dedupe_segments(F.col(col))).otherwise(F.col(col))}, "Repeated segment"
    )


def classify_cells(df: DataFrame, arr: str) -> DataFrame:
    """Split a row's cells by content into ``emails``, ``phones`` and ``others``."""
    def kind(x: Column) -> Column:
        return F.when(tx.has_email(x), "emails").when(x.rlike(tx.PHONE_RUN), "phones").otherwise("others")

    cells = F.array_distinct(F.filter(F.transform(arr, tx.clean), lambda x: x != ""))
    tagged = df.withColumn("_cells", cells).withColumn(
        "_cells", F.transform("_cells", lambda x: F.struct(kind(x).alias("kind"), x.alias("text")))
    )
    of = lambda name: F.transform(F.filter("_cells", lambda x: x["kind"] == name), lambda x: x["text"])
    return tagged.withColumns({name: of(name) for name in ("emails", "phones", "others")}).drop("_cells")


# Technical abbreviations kept in capitals.  Names of companies are passed by the caller.
ABBREVIATIONS = (
    "AIS", "GIS", "HVDC", "HVAC", "SCADA", "SLDC", "RLDC", "NLDC", "WRLDC", "NRLDC", "ERLDC",
    "SRLDC", "NERLDC", "CTU", "ISTS", "STATCOM", "FACTS", "SVC", "OLTC", "EHV", "HV", "LV",
    "MW", "MVAR", "KVAR", "DC", "AC", "UPS", "RTU", "PLCC", "PMU", "DCB", "VCB", "SF6",
    "CT", "PT", "CVT", "ABT", "DSM", "RLNG", "IPP", "MVA",
)
# Ordinary words that are title-cased although short and in capitals.
# Names of places and companies are passed by the caller.
ORDINARY_WORDS = (
    "control", "room", "rooms", "station", "stations", "switchyard", "switch", "yard",
    "region", "regions", "western", "eastern", "northern", "southern", "central", "other",
    "main", "new", "old", "state", "phase", "project", "projects", "mega", "atomic",
    "nuclear", "thermal", "hydro", "hydel", "solar", "wind", "energy", "power", "plant",
    "plants", "load", "despatch", "dispatch", "network", "operation", "operations",
    "maintenance", "commercial", "technical", "communication", "communications",
    "scheduling", "backup", "office", "law", "department", "corporation", "company",
    "companies", "limited", "private", "transmission", "distribution", "generation",
    "generator", "generators", "generating", "connected", "buyers", "board", "committee",
    "regulatory", "development", "accounting", "port", "ports", "special", "economic",
    "zone", "holding", "service", "services", "trust", "group", "steel", "cement", "cements",
    "health", "care", "medical", "hospital", "hospitals", "research", "centre", "center",
    "institute", "facility", "campus", "floor", "address", "engineer", "engineers",
    "manager", "managers", "chief", "general", "deputy", "assistant", "senior", "executive",
    "additional", "joint", "principal", "officer", "officers", "director", "directors",
    "head", "secretary", "president", "vice", "associate", "important", "vendors", "hotline",
    "hotlines", "nos", "directory", "nodal", "provider", "providers", "charge",
    "incharge", "substation", "blood", "bank", "fire", "police", "disaster",
    "management", "emergency", "contact", "numbers", "grid", "controller",
    "and", "of", "for", "the", "at", "in", "on", "to", "a", "an", "with", "by",
    "cyber", "junior", "system", "data", "red",
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "twenty", "thirty", "forty", "fifty", "sixty", "seventy",
    "eighty", "ninety", "hundred",
)


def _cased(word: Column, abbreviations: Sequence[str], words: Sequence[str]) -> Column:
    up, low = F.upper(word), F.lower(word)
    title = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))
    plural = [a + "S" for a in abbreviations]
    return (
        F.when(~word.rlike("[A-Za-z]"), word)
        .when(word.rlike("(?i)^[0-9]+(st|nd|rd|th)$"), low)
        .when(up.isin(list(abbreviations)), up)
        .when(low == "kv", F.lit("kV"))
        .when(up.isin(plural), F.concat(F.substr(up, F.lit(1), F.length(up) - 1), F.lit("s")))
        .when(low.isin(list(words)), title)
        .when((word == up) & (F.length(word) <= 6), word)
        .otherwise(title)
    )


def label_case(
    c: Column,
    split_hyphens: bool,
    abbreviations: Sequence[str] = ABBREVIATIONS,
    words: Sequence[str] = ORDINARY_WORDS,
) -> Column:
    """Title case that keeps abbreviations, ordinals and the kV unit."""
    c = F.regexp_replace(c, r"(?i)([0-9]+)\s*-?\s*kv\b", "$1 kV")
    if split_hyphens:
        c = F.regexp_replace(c, r"(?<=\w)-(?=\w)", " ")
    c = tx.clean(c)
    tokens = F.regexp_extract_all(c, F.lit(r"((?i)[0-9]+(?:st|nd|rd|th)\b|[A-Za-z]+|[^A-Za-z])"), F.lit(1))
    return F.array_join(F.transform(tokens, lambda w: _cased(w, abbreviations, words)), "")


def normalize_labels(
    df: DataFrame,
    key: str,
    designations: Sequence[str] = (),
    names: Sequence[str] = (),
    abbreviations: Sequence[str] = ABBREVIATIONS,
    words: Sequence[str] = ORDINARY_WORDS,
) -> Standardized:
    """Formatting of labels: hyphens split in designations, kept in names."""
    new, why = {}, {}
    for col in (*designations, *names):
        old = F.col(col)
        new[col] = label_case(old, col in designations, abbreviations, words)
        reasons = F.array_compact(
            F.array(
                F.when(old.rlike(r"(?i)[0-9]+\s*-?\s*kv\b") & ~old.rlike(r"[0-9]+ kV\b"), "Abbreviation preserved"),
                F.when(F.lit(col in designations) & old.rlike(r"\w-\w"), "Separator normalization"),
                F.when(tx.clean(old) != old, "Whitespace"),
                F.when(
                    F.lower(F.regexp_replace(old, r"[\s-]+", "")) == F.lower(F.regexp_replace(new[col], r"[\s-]+", "")),
                    F.when(
                        F.regexp_replace(old, r"[\s-]+", "") != F.regexp_replace(new[col], r"[\s-]+", ""),
                        "Capitalization",
                    ),
                ),
            )
        )
        why[col] = F.array_join(reasons, "; ")
    return standardize(df, key, new, why)


def repair_text(df: DataFrame, key: str, cols: Sequence[str]) -> Standardized:
    """One dash character, no replacement characters, split capitals rejoined."""
    def fixed(c: str) -> Column:
        out = tx.unify_dashes(F.col(c))
        # the capitals it goes with may have accents
        out = F.regexp_replace(out, r"\b([A-Z])\s+(\p{Lu}{2,})\b", "$1$2")
        return F.regexp_replace(out, r"\b([A-Z])\s+([a-z])", "$1$2")

    return standardize(df, key, {c: fixed(c) for c in cols}, "Repaired text")


def map_headers(headers: DataFrame, table: str, pos: str, header: str, rules: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Field of each raw header by ordered keywords; the first column wins a field.

    A header takes its first matching rule; per table and field the leftmost such
    header is mapped, others are reported with ``is_mapped`` false.
    """
    ordered = [Rule(field, "_h", contains=words) for field, words in rules]
    tagged = headers.withColumn("_h", tx.folded(F.col(header))).withColumn("field", first_match(ordered))
    first = tagged.where(F.col("field").isNotNull()).groupBy(table, "field").agg(F.min(pos).alias("_first"))
    return (
        tagged.join(first, [table, "field"], "left")
        .withColumn("is_mapped", F.coalesce(F.col(pos) == F.col("_first"), F.lit(False)))
        .drop("_h", "_first")
    )


def pick_label(df: DataFrame, a: str, b: str, generic: Sequence[str], out: str = "label") -> DataFrame:
    """The specific one of two cells: not blank and not just the category word."""
    ca, cb = tx.clean(F.col(a)), tx.clean(F.col(b))
    bare = lambda c: F.coalesce(F.lower(c).isin(list(generic)), F.lit(False))
    blank_a, blank_b = tx.is_blank(F.col(a)), tx.is_blank(F.col(b))
    label = (
        F.when(bare(cb) & ~bare(ca) & ~blank_a, ca)
        .when(bare(ca) & ~bare(cb) & ~blank_b, cb)
        .when(blank_a, cb)
        .otherwise(ca)
    )
    return df.withColumn(out, label)


IDENTITY = {"person_name": "name", "title": "title", "email": "email", "mobile": "mobile"}


def resolve_identity(heads: DataFrame, people: DataFrame) -> DataFrame:
    """Role holders with the linked person's fields, or their own when not linked."""
    linked = F.col("h.person_id").isNotNull()
    person = people.select(
        F.col("person_id"), F.col("person_name").alias("p_name"), F.col("title").alias("p_title"),
        F.col("email").alias("p_email"), F.col("mobile").alias("p_mobile"), F.col("status").alias("person_status"),
    )
    return heads.alias("h").join(person.alias("p"), F.col("h.person_id") == F.col("p.person_id"), "left").select(
        "h.head_id", "h.org_id", "h.role_title", "h.role_category", "h.status", "h.person_id", "person_status",
        F.when(linked, F.col("p_name")).otherwise(F.col("name")).alias("name"),
        F.when(linked, F.col("p_title")).otherwise(F.col("role_title")).alias("title"),
        F.when(linked, F.col("p_email")).otherwise(F.col("h.email")).alias("email"),
        F.when(linked, F.col("p_mobile")).otherwise(F.col("h.mobile")).alias("mobile"),
    )


def to_contact_rows(
    people: DataFrame | None = None, heads: DataFrame | None = None, places: DataFrame | None = None
) -> DataFrame:
    """People, resolved role holders and places in one shape."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    parts = []
    if people is not None:
        parts.append(people.select(
            "org_id", F.lit("person").alias("record_type"), F.col("person_id").alias("record_id"),
            blank("person_name").alias("name"), blank("title").alias("title"), blank("email").alias("email"), blank("mobile").alias("mobile"),
        ))
    if heads is not None:
        parts.append(heads.select(
            "org_id", F.lit("role").alias("record_type"), F.col("head_id").alias("record_id"),
            blank("name").alias("name"), blank("title").alias("title"), blank("email").alias("email"), blank("mobile").alias("mobile"),
        ))
    if places is not None:
        parts.append(places.select(
            "org_id", F.lit("place").alias("record_type"), F.col("place_id").alias("record_id"),
            blank("label").alias("name"), F.coalesce("category", "label", F.lit("")).alias("title"), blank("email").alias("email"),
            blank("phone").alias("mobile"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Browser and system patterns, first match wins.
BROWSERS = (
    ("Edge", r"Edg(?:e|A|iOS)?/[0-9.]+"),
    ("Opera", r"(?:OPR|Opera)/[0-9.]+"),
    ("Chrome", r"Chrome/[0-9.]+"),
    ("Firefox", r"Firefox/[0-9.]+"),
    ("Safari", r"Version/[0-9.]+.*Safari"),
    ("Internet Explorer", r"MSIE [0-9.]+|rv:[0-9.]+\).*like Gecko$"),
)
SYSTEMS = (
    ("Windows 11/10", r"Windows NT 10\.0"),
    ("Windows 8.1", r"Windows NT 6\.3"),
    ("Windows 8", r"Windows NT 6\.2"),
    ("Windows 7", r"Windows NT 6\.1"),
    ("Windows", r"Windows NT"),
    ("Android", r"Android [0-9.]+"),
    ("iOS", r"i(?:Phone|Pad|Pod).*OS [0-9]+"),
    ("macOS", r"Mac OS X [0-9_.]+"),
    ("Linux", r"Linux"),
)


def client_breakdown(audit: DataFrame, agent: str) -> DataFrame:
    """Changes by browser and operating system of the client text."""
    browser = first_match([Rule(n, agent, regex=p) for n, p in BROWSERS])
    system = first_match([Rule(n, agent, regex=p) for n, p in SYSTEMS])
    return (
        audit.select(browser.alias("browser"), system.alias("system"))
        .groupBy("browser", "system")
        .agg(F.count(F.lit(1)).alias("n_changes"))
    )


# Row kinds in rule order.
SWITCHYARD_WORDS = ("switchyard", "switch yard")
CONTROL_ROOM_WORDS = ("control room", "control  room", "controlroom", "hotline", "power house")
FACILITY = r"(?i)\b(S/S|CR|PSS|AIS|GIS)\b|[0-9]+\s*kv\b"


def row_kind(
    df: DataFrame,
    cols: Sequence[str],
    order: Sequence[tuple[str, Callable[[Column], Column]]] | None = None,
    out: str = "kind",
) -> DataFrame:
    """switchyard / control_room / facility / person, first matching rule."""
    joined = F.concat_ws(" ", *cols)
    order = order or [
        ("switchyard", lambda c: tx.contains_any(c, SWITCHYARD_WORDS)),
        ("control_room", lambda c: tx.contains_any(c, CONTROL_ROOM_WORDS)),
        ("facility", lambda c: c.rlike(FACILITY)),
    ]
    kind = None
    for name, test in order:
        kind = F.when(test(joined), name) if kind is None else kind.when(test(joined), name)
    return df.withColumn(out, kind.otherwise("person"))
