"""Segmentation of ordered document blocks.

State runs along the rows of a document (last heading, running section number);
``carry`` cuts long documents into chunks, so one huge document is not one task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import text as tx
from rosterloom.functions.contain import contained
from rosterloom.functions.skew import carry
from rosterloom.session import durable

# Fixed values.
NUMBERED_TITLE = r"^[0-9]+(\.[0-9]+)*\.\s*[A-Za-z]"
NAME_HEADERS = ("name",)
TITLE_HEADERS = ("designation", "title")
# General signs of an address line.  Names of places, buildings and roads are passed by the caller.
ADDRESS_WORDS = (
    "p.o.", "p.o ", "dist.", "dist:", " dist ", "pin :", "pin code",
    "village", "sector", "floor",
    "ph no", "fax no", "email:",
    "opp ", "near ", "plot no",
    "substation compound",
    "road no", "road,", "nagar,", "nagar.",
    "pincode",
    "mob:", "mob :",
    "po:", "po :", "p.o:",
)
SEPARATOR_LINE = r"^[\s\-_=*.#~|]+$"


def fill_heading(blocks: DataFrame, doc: str, order: str, is_heading: Column, text: str, ranges: int | None = None) -> DataFrame:
    """Add ``heading``: the text of the last heading up to the row."""
    return carry(blocks, [doc], [order], last={"heading": F.when(is_heading, F.col(text))}, ranges=ranges)


def fill_levels(blocks: DataFrame, doc: str, order: str, is_section: Column, is_heading: Column, text: str) -> DataFrame:
    """Add ``section`` (enclosing top level) and ``heading`` (nearest of any level)."""
    return carry(
        blocks, [doc], [order],
        last={
            "section": F.when(is_section, F.col(text)),
            "heading": F.when(is_section | is_heading, F.col(text)),
        },
    )


def is_header_row(cells: Column) -> Column:
    """A row naming both a name column and a title column."""
    has = lambda words: F.exists(cells, lambda c: F.lower(F.trim(c)).isin(list(words)))
    return has(NAME_HEADERS) & has(TITLE_HEADERS)


def mark_sections(rows: DataFrame, doc: str, order: str, cells: str, names: DataFrame, name: str) -> DataFrame:
    """Add ``row_kind`` (title, banner, noise_banner, header, blank, data), ``is_break``
    and ``section_title``.

    A numbered first cell is a title.  A banner repeats one text over at least two
    cells; it opens a section only if a header follows within two rows and the
    text resolves to a known name (equal, or one inside the other).
    """
    filled = F.filter(F.transform(cells, tx.clean), lambda c: c != "")
    # what the cells say is settled once: every count, sample and window below reads the rows again
    read = F.transform(F.array(filled), lambda c: F.struct(
        F.coalesce(F.get(c, F.lit(0)), F.lit("")).alias("first"), F.size(c).alias("n"), is_header_row(c).alias("header"), F.size(F.array_distinct(c)).alias("kinds"),
    ))
    rows = rows.withColumn("_read", F.get(read, F.lit(0)))
    first, header = F.col("_read.first"), F.col("_read.header")
    repeats = (F.col("_read.n") >= 2) & (F.col("_read.kinds") == 1) & ~header
    rows = durable(rows.withColumn("_key", F.when(repeats, F.lower(tx.strip_serial(first)))))

    # banner texts that resolve to a known name
    keys = rows.where(F.col("_key").isNotNull()).select("_key").distinct()
    known_names = names.select(F.lower(F.trim(name)).alias("_name")).distinct()
    known = (
        keys.join(known_names, F.col("_key") == F.col("_name"), "left_semi")
        .union(contained(keys, "_key", known_names, "_name").select("_key"))
        .union(contained(known_names, "_name", keys, "_key").select("_key"))
        .distinct()
        .withColumn("_known", F.lit(True))
    )

    # both windows run in the document's own partition: one exchange unless a document is cut
    rows = durable(carry(rows, [doc], [order], number="_no"))
    rows = carry(rows, [doc], ["_no"], following={"_next_header": F.when(header, F.col("_no"))})
    rows = rows.join(known, "_key", "left")
    confirmed = F.coalesce((F.col("_next_header") - F.col("_no")) <= 2, F.lit(False)) & F.coalesce("_known", F.lit(False))
    kind = (
        F.when(F.col("_read.n") == 0, "blank")
        .when(first.rlike(NUMBERED_TITLE), "title")
        .when(repeats & confirmed, "banner")
        .when(repeats, "noise_banner")
        .when(header, "header")
        .otherwise("data")
    )
    out = rows.withColumn("row_kind", kind).withColumn("is_break", F.col("row_kind").isin("title", "banner"))
    return out.withColumn("section_title", F.when(F.col("is_break"), tx.strip_serial(first))).drop(
        "_read", "_no", "_next_header", "_key", "_known"
    )


def segments(marked: DataFrame, doc: str, order: str) -> DataFrame:
    """Number the sections of a marked document and carry their titles to the rows."""
    return carry(
        marked, [doc], [order],
        sums={"segment_no": F.col("is_break").cast("bigint")},
        last={"segment_title": F.col("section_title")},
    )


def segment_sizes(numbered: DataFrame, doc: str) -> DataFrame:
    return numbered.groupBy(doc, "segment_no").agg(
        F.max("segment_title").alias("segment_title"), F.count_if(F.col("row_kind") == "data").alias("n_rows")
    )


def drop_noise(lines: DataFrame, line: str, junk: Sequence[str], headers: Sequence[str] = ()) -> DataFrame:
    """Keep content lines: no blanks, separators, header words or listed slogans."""
    text = F.lower(tx.clean(F.col(line)))
    slogan = F.exists(F.array(*[F.lit(w.lower()) for w in junk]), lambda w: F.col("_t").contains(w)) if junk else F.lit(False)
    noise = F.col("_t").rlike(SEPARATOR_LINE) | slogan | F.col("_t").isin(["", *headers])
    # the flag keeps the cleaned text one column instead of one copy per test
    return lines.withColumn("_t", text).withColumn("_noise", noise).where(~F.col("_noise")).drop("_t", "_noise")


def address_like(c: Column, words: Sequence[str] = ADDRESS_WORDS, places: Sequence[str] = ()) -> Column:
    """A line that reads as an address.

    It is a line of digits only (a code or a number), holds an address word or a six-digit
    code, names a place followed by a dash and a code, or ends in a place; the last does
    not count in a line with an abbreviation of three capitals or more, which names an organization.
    """
    out = F.trim(c).rlike(r"^[0-9][0-9\s]{4,9}$") | tx.contains_any(c, words) | c.rlike(r"\b[0-9]{6}\b")
    if places:
        named = r"(?i)\b(" + "|".join(re.escape(p) for p in places) + ")"
        out = out | c.rlike(named + r"\s*[-–]\s*[0-9]{3}")
        out = out | (c.rlike(named + r"\s*[,.]?\s*$") & ~c.rlike(r"\b[A-Z]{3,}\b"))
    return out


def capture_paragraph(
    numbered: DataFrame, doc: str, order: str, text: str, is_table: Column,
    words: Sequence[str] = ADDRESS_WORDS, places: Sequence[str] = (),
) -> DataFrame:
    """Per segment, the first address-like free paragraph before its table."""
    free = ~is_table & ~F.col("is_break") & address_like(F.col(text), words, places)
    per = numbered.groupBy(doc, "segment_no").agg(
        F.min(F.when(free, F.struct(F.col(order).alias("at"), F.col(text).alias("text")))).alias("_c"),
        F.min(F.when(is_table, F.col(order))).alias("_table"),
    )
    before = F.col("_table").isNull() | (F.col("_c.at") < F.col("_table"))
    return per.select(doc, "segment_no", F.when(before, F.col("_c.text")).alias("address"))


def merge_by_label(df: DataFrame, section: str, label: str, values: dict[str, Column], order: str) -> DataFrame:
    """Union of the set-valued fields of records sharing a label within a section.

    One row per (section, label, field, value), with its first position; a label
    shared by very many records never becomes one array.
    """
    tagged = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("items")) for f, v in values.items()])
    rows = df.select(section, F.lower(tx.clean(F.col(label))).alias("label_key"), order, F.inline(tagged))
    return (
        rows.select(section, "label_key", "field", order, F.explode("items").alias("value"))
        .groupBy(section, "label_key", "field", "value")
        .agg(F.min(order).alias("first_at"), F.count(F.lit(1)).alias("n_records"))
    )
