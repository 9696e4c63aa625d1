"""The batch reconciliation of a directory document against the store, from ordered rows to a load.

Segment, resolve, compare, set naming differences aside, suggest, decide, load: the operators of the
other modules in their order.  Rows are written at the decision points only: the findings, which people look at, and
the load, which is one commit.  Sections that are no station of the store are returned and not compared.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.functions import text as tx
from rosterloom.functions.joins import join_on
from rosterloom.functions.skew import numbered_by_range
from rosterloom.session import durable, spread
from rosterloom.sources import commit, sinks

from . import reconcile, segment
from .correct import apply_decisions
from .resolve import match_station

PLACES = ("Control Room", "Switchyard")


@dataclass(frozen=True)
class Reconciled:
    """``entries`` of the document with their organization, ``skipped`` sections, ``findings`` with their status,
    ``artifacts`` (pairs of findings that are one thing), ``perfect`` stations, ``moves`` and those still ``open_moves``."""

    entries: DataFrame
    skipped: DataFrame
    findings: DataFrame
    artifacts: DataFrame
    perfect: DataFrame
    moves: DataFrame
    open_moves: DataFrame


def directory_entries(
    rows: DataFrame, doc: str, order: str, cells: str, tree: DataFrame, places: Sequence[str] = PLACES
) -> tuple[DataFrame, DataFrame]:
    """(entries, skipped): the data rows of a document's sections as (org_id, station, category, name), and the titles
    of sections that resolve to no organization of ``tree`` (org_id, org_name, parent_id).

    The first filled cell is a name; a second that is one of ``places`` is its category, any other makes it an Employee.
    """
    # one step reads the rows of the one before again and again, so each is settled; the cells are read by all tasks
    marked = durable(segment.mark_sections(spread(rows, doc, order), doc, order, cells, tree, "org_name"))
    numbered = segment.segments(marked, doc, order).where("row_kind = 'data' AND segment_title IS NOT NULL")
    filled = F.filter(F.transform(cells, tx.clean), lambda c: c != "")
    kind = F.get(filled, F.lit(1))
    read = durable(numbered.select(
        F.lower(F.trim("segment_title")).alias("title"), F.get(filled, F.lit(0)).alias("name"),
        F.when(kind.isin(list(places)), kind).otherwise("Employee").alias("category"),
    ))
    names = tree.select("org_id", "org_name", "parent_id", F.lower(F.trim("org_name")).alias("key"))
    titles = read.select("title").distinct()
    found = match_station(titles, "title", names.where("parent_id IS NOT NULL"), names.where("parent_id IS NULL"), "org_id", "key")
    found = durable(found.join(names.select("org_id", F.col("org_name").alias("station")), "org_id", "left"))
    entries = read.join(found.where("org_id IS NOT NULL").select("title", "org_id", "station"), "title").drop("title")
    return entries, found.where("org_id IS NULL").select("title")


def directory_findings(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """(finding_id, station, category, issue, name) of the stations that the document has; ``stored`` has (station, category, name)."""
    slot, key = F.struct("station", "category").alias("slot"), tx.folded(F.col("name")).alias("key")
    a = entries.select(slot, key, "name")
    b = join_on(stored, entries.select("station").distinct(), "station", "left_semi").select(slot, key, "name")
    found = reconcile.presence_diff(a, b, "slot", "key")
    spelled = a.unionByName(b).groupBy("slot", "key").agg(F.min("name").alias("name"))
    found = join_on(found, spelled, ["slot", "key"]).select("slot.station", "slot.category", "issue", "name", "key")
    return numbered_by_range(found, [], ["station", "category", "key", "issue"], "finding_id").drop("key")


def reconcile_directory(
    rows: DataFrame, doc: str, order: str, cells: str, tree: DataFrame, stored: DataFrame, decisions: DataFrame
) -> Reconciled:
    """From a document's rows to open move suggestions.

    ``stored`` has (station, category, name), ``decisions`` (name_key, decision) of earlier reviews.
    """
    entries, skipped = directory_entries(rows, doc, order, cells, tree)
    entries = durable(entries)
    findings = durable(directory_findings(entries, stored))
    pairs = durable(reconcile.pair_artifacts(findings))
    paired = pairs.select(F.explode(F.array("missing_id", "extra_id")).alias("finding_id")).distinct().withColumn("_paired", F.lit(True))
    findings = findings.join(paired, "finding_id", "left").withColumn("status", F.when(F.col("_paired"), "naming difference").otherwise("open")).drop("_paired")
    still = findings.where("status = 'open'")
    stations = entries.select("station").distinct()
    perfect = reconcile.perfect_groups(stations, still, "station").where("is_perfect").select("station")
    people = stored.where("category = 'Employee'")
    moves = durable(reconcile.suggest_moves(still.where("category = 'Employee' AND issue IN ('Missing', 'Extra')"), stations, people))
    waiting = reconcile.pending(moves.where("action = 'move'"), decisions, ["name_key"])
    return Reconciled(entries, skipped, findings, pairs, perfect, moves, waiting)


def load_decided(
    done: Reconciled, people: DataFrame, key: str, name: str, station: str, decisions: DataFrame, path: str, run: str
) -> tuple[int, DataFrame]:
    """Apply the approved moves to ``people`` and load the result as one commit below ``path``: (its number, moves not found)."""
    approved = decisions.where("decision = 'approved'").select("name_key").distinct()
    act = done.moves.where("action = 'move' AND to_station IS NOT NULL").join(approved, "name_key").select(
        F.xxhash64("name_key").alias("decision_id"), F.col("name_key").alias("name"), F.col("from_station").alias("old_org"), "action", F.col("to_station").alias("new_org")
    )
    rows, missing = apply_decisions(people, key, name, station, act)
    rows = durable(rows)
    return commit.replace_owners(rows, path, station, sinks.run_record(people, rows, key, [name, station], run)), missing
