"""Column expressions over contact text.  All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and separators the results depend on.
BLANKS = "\t\n\x0b\f\r\u00a0\u200b\ufeff"
PHONE_RUN = r"[0-9]{5,}"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"
SERIAL = r"^[0-9]+(\.[0-9]+)*\.?\s*"
SEGMENTS = r"[/;,]"
JOINER = " / "
HONORIFICS = r"\b(shri|smt|mr|mrs|ms|dr)\b\.?"
PLACEHOLDERS = ("", "-", "--", "na", "n/a", "n a", "nil", "none")
DASHES = ("‐", "‑", "‒", "–", "—", "−")


def clean(c: Column) -> Column:
    """Collapse whitespace (with no-break and zero-width blanks) and trim."""
    spaced = F.translate(c, BLANKS, " " * len(BLANKS))
    # the pattern only runs where blanks touch
    return F.trim(F.when(spaced.contains("  "), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced))


def blank_to_null(c: Column) -> Column:
    return F.nullif(clean(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return F.coalesce(clean(c), F.lit("")) == ""


def folded(c: Column) -> Column:
    """Lower case, cleaned, never null: the tolerant form of a scalar."""
    return F.coalesce(F.lower(clean(c)), F.lit(""))


def strip_serial(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SERIAL, ""))


def strip_prefixes(c: Column, prefixes: Sequence[str]) -> Column:
    """Remove the longest listed prefix, ignoring case."""
    low = F.lower(c)
    out = c
    for p in sorted(prefixes, key=lambda x: (len(x), x)):
        out = F.when(low.startswith(p.lower()), F.trim(F.substr(c, F.lit(len(p) + 1)))).otherwise(out)
    return out


def match_key(c: Column, flavour: str = "words", aliases: Mapping[str, str] | None = None) -> Column:
    """Comparison key of a label.

    words: letters and digits, single spaces; compact: letters and digits only;
    letters: letters only; person: honorifics dropped, "&" read as "and".
    """
    k = F.lower(clean(c))
    for old, new in (aliases or {}).items():
        k = F.regexp_replace(k, rf"\b{old}\b", new)
    if flavour == "compact":
        return F.regexp_replace(k, r"[^a-z0-9]+", "")
    if flavour == "letters":
        return F.regexp_replace(k, r"[^a-z]+", "")
    if flavour == "person":
        k = F.regexp_replace(F.regexp_replace(k, "&", " and "), HONORIFICS, " ")
    elif flavour != "words":
        raise ValueError(f"unknown flavour {flavour!r}")
    return F.trim(F.regexp_replace(k, r"[^a-z0-9]+", " "))


def phone_set(*cols: Column, min_digits: int = 5) -> Column:
    """Sorted distinct digit runs of at least ``min_digits``."""
    joined = F.concat_ws(" ", *cols)
    runs = F.regexp_extract_all(joined, F.lit(rf"([0-9]{{{min_digits},}})"), F.lit(1))
    return F.array_sort(F.array_distinct(runs))


def email_set(*cols: Column) -> Column:
    return F.array_sort(F.array_distinct(emails_in(F.lower(F.concat_ws(" ", *cols)))))


def emails_in(c: Column) -> Column:
    """All addresses of a text, in order; the pattern only runs where an "@" is."""
    found = F.regexp_extract_all(c, F.lit(f"({EMAIL})"), F.lit(1))
    return F.when(c.contains("@"), found).otherwise(F.array().cast("array<string>"))


def has_email(c: Column) -> Column:
    return c.contains("@") & c.rlike(EMAIL)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]+", "")


def national_number(c: Column, mode: str = "strict", country: str = "91") -> Column:
    """Ten-digit national number, or null where the text does not settle it."""
    d = digits(c)
    if mode == "strict":
        return (
            F.when((F.length(d) == 12) & d.startswith(country), F.substr(d, F.lit(3)))
            .when((F.length(d) == 11) & d.startswith("0"), F.substr(d, F.lit(2)))
            .when(F.length(d) == 10, d)
        )
    if mode != "lenient":
        raise ValueError(f"unknown mode {mode!r}")
    d = F.regexp_replace(d, "^0+", "")
    d = F.when((F.length(d) > 10) & d.startswith(country), F.substr(d, F.lit(len(country) + 1))).otherwise(d)
    d = F.when(F.length(d) > 10, F.right(d, F.lit(10))).otherwise(d)
    return F.nullif(d, F.lit(""))


def segments(c: Column, pattern: str = SEGMENTS) -> Column:
    """Trimmed non-empty parts of a multi-valued text."""
    return F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != "")


def dedupe_segments(c: Column, pattern: str = SEGMENTS, joiner: str = JOINER) -> Column:
    return F.array_join(F.array_distinct(segments(c, pattern)), joiner)


def max_repeat(arr: Column) -> Column:
    """Most frequent element's count."""
    return F.coalesce(
        F.array_max(
            F.transform(F.array_distinct(arr), lambda x: F.size(F.filter(arr, lambda y: y == x)))
        ),
        F.lit(0),
    )


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Case-insensitive containment of any listed word."""
    low = F.lower(c)
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w.lower())
    return hit


def unify_dashes(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, "�", ""), "".join(DASHES), "-" * len(DASHES))


def is_email(c: Column) -> Column:
    return F.trim(c).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")
