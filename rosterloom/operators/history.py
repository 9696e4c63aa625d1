"""History: status changes, timelines, versions, snapshots and audit views."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions.joins import join_on
from rosterloom.functions.skew import carry
from rosterloom.sources import commit

from .stats import STATUSES


def apply_status(
    events: DataFrame, people: DataFrame, statuses: Sequence[str] = STATUSES, ranges: int | None = None
) -> DataFrame:
    """Status history (event_id, person_id, ts, old_status, new_status).

    ``events`` has (event_id, person_id, ts, new_status).  Only valid statuses that
    differ from the one before count; a person starts with the stored status.
    """
    valid = events.where(F.col("new_status").isin(list(statuses))).withColumn(
        "_us", F.unix_micros(F.col("ts").cast("timestamp"))
    )
    seen = carry(valid, ["person_id"], ["_us", "event_id"], lag={"_before": F.col("new_status")}, ranges=ranges)
    start = people.select("person_id", F.col("status").alias("_start"))
    old = F.coalesce("_before", "_start")
    return (
        seen.join(start, "person_id")
        .withColumn("old_status", old)
        .where(F.col("old_status") != F.col("new_status"))
        .select("event_id", "person_id", "ts", "old_status", "new_status")
    )


def end_roles(history: DataFrame, roles: DataFrame) -> DataFrame:
    """Open roles ended by the first change that takes their person out of ACTIVE."""
    leaving = history.where("new_status <> 'ACTIVE'").groupBy("person_id").agg(
        F.min(F.struct("ts", "event_id", "new_status")).alias("e")
    )
    return roles.where("person_id IS NOT NULL").join(leaving, "person_id").select(
        "head_id", "person_id", F.col("e.event_id").alias("event_id"),
        F.concat(F.lit("status changed to "), F.col("e.new_status")).alias("reason"),
    )


def timeline(snapshots: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Changes between successive states of each key; only changed pairs are filled."""
    before = carry(snapshots, [key], order, lag={f"_b_{c}": F.col(c) for c in cols}, number="_no")
    changed = [~F.col(f"_b_{c}").eqNullSafe(F.col(c)) for c in cols]
    any_change = changed[0]
    for c in changed[1:]:
        any_change = any_change | c
    pairs = []
    for c, diff in zip(cols, changed):
        pairs += [F.when(diff, F.col(f"_b_{c}")).alias(f"old_{c}"), F.when(diff, F.col(c)).alias(f"new_{c}")]
    return before.where((F.col("_no") > 1) & any_change).select(key, *order, *pairs)


def single_flag(df: DataFrame, parent: str, key: str, events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Exactly the last flagged child of each parent is flagged."""
    last = events.groupBy(parent).agg(F.max_by(key, F.struct(*order)).alias("_flagged"))
    return df.join(last, parent, "left").withColumn("is_primary", F.coalesce(F.col(key) == F.col("_flagged"), F.lit(False))).drop("_flagged")


def number_versions(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Version labels per (year, month): base for the first, then base.2, base.3 ..."""
    have = existing.groupBy("year", "month").agg(F.count(F.lit(1)).alias("_have"))
    rows = carry(requests, ["year", "month"], ["request_id"], number="_no").join(have, ["year", "month"], "left")
    n = F.col("_no") + F.coalesce("_have", F.lit(0))
    base = F.concat_ws(".", F.col("year").cast("string"), F.lpad(F.col("month").cast("string"), 2, "0"))
    return rows.select(
        "request_id", "year", "month", F.concat_ws(".", base, F.when(n > 1, n.cast("string"))).alias("version_number")
    )


def snapshot_counts(rows: DataFrame, version: str) -> DataFrame:
    return rows.groupBy("section").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("org_name").alias("n_orgs")).withColumn(
        "version", F.lit(version)
    )


def publish_snapshot(rows: DataFrame, path: str, version: str) -> DataFrame:
    """Write the directory under an immutable version; an existing one is an error."""
    target = f"{path}/version={version}"
    rows.write.mode("errorifexists").partitionBy("section").parquet(target)
    return snapshot_counts(rows.sparkSession.read.parquet(target), version)


VERSION_RECORD = "version string, year int, month int, remarks string, generated_by bigint, generated_at timestamp, n_rows bigint, n_orgs bigint, status string"
AUDIT_RECORD = "record string, action string, field string, old_value string, new_value string, reason string, actor bigint, at timestamp"
VERSION_MANIFEST = f"rows string, record struct<{VERSION_RECORD}>, audit struct<{AUDIT_RECORD}>"


def _fields(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def version_records(spark: SparkSession, path: str) -> DataFrame:
    """The latest record of every version: a deleted version keeps its number and its record."""
    stored = commit.manifests(spark, path, VERSION_MANIFEST).select("record.*")
    deleted = stored.where("status = 'DELETED'").select("version", F.lit(True).alias("_gone")).distinct()
    status = F.when(F.col("_gone"), "DELETED").otherwise(F.col("status"))
    return stored.where("status <> 'DELETED'").join(deleted, "version", "left").withColumn("status", status).drop("_gone")


def version_audit(spark: SparkSession, path: str) -> DataFrame:
    return commit.manifests(spark, path, VERSION_MANIFEST).select("audit.*")


def version_rows(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The rows of a published version that is not deleted."""
    live = version_records(spark, path).where((F.col("version") == version) & (F.col("status") != "DELETED")).select("version")
    found = commit.manifests(spark, path, VERSION_MANIFEST).where(F.col("rows").isNotNull()).select("rows", "record.version").join(live, "version").head()
    if found is None:
        raise ValueError(f"no version {version}")
    return spark.read.parquet(f"{path}/{found['rows']}")


def publish_version(
    rows: DataFrame, path: str, year: int, month: int, at: datetime, actor: int | None = None, remarks: str | None = None,
    regenerate: bool = False,
) -> str:
    """Publish the rows as the month's version, with a version record and an audit record; returns its number.

    Rows, record and audit become visible by one manifest: a call that stops before leaves no version and blocks no
    number.  A month that has a version is refused unless ``regenerate`` asks for its next
    revision; no earlier version is touched.  The numbers read are those of one month.
    """
    spark = rows.sparkSession
    before = commit.latest(spark, path)
    known = {r["version"]: r["status"] for r in version_records(spark, path).where((F.col("year") == year) & (F.col("month") == month)).collect()}
    if not regenerate and any(s != "DELETED" for s in known.values()):
        raise ValueError(f"{year}.{month:02d} has a version; ask for its next revision")
    base = f"{year}.{month:02d}"
    revisions = (base if n == 1 else f"{base}.{n}" for n in count(1))
    version = next(v for v in revisions if v not in known)
    staged = commit.stage(rows, path, ["section"])
    sums = spark.read.parquet(f"{path}/{staged}").agg(F.count(F.lit(1)), F.count_distinct("org_name")).head()
    when = at.isoformat()
    record = (version, year, month, remarks, actor, when, *sums, "GENERATED")
    audit = (version, "REGENERATE" if regenerate else "GENERATE", "version_number", None, version, remarks, actor, when)
    named = {"record": dict(zip(_fields(VERSION_RECORD), record)), "audit": dict(zip(_fields(AUDIT_RECORD), audit))}
    commit.publish(spark, path, {"rows": staged, **named}, before)
    return version


def delete_version(spark: SparkSession, path: str, version: str, at: datetime, actor: int | None = None) -> None:
    """Mark a version as deleted, with an audit record; its rows stay for the record."""
    before = commit.latest(spark, path)
    found = version_records(spark, path).where((F.col("version") == version) & (F.col("status") != "DELETED")).head()
    if found is None:
        raise ValueError(f"no version {version}")
    record = found.asDict() | {"generated_at": found["generated_at"].isoformat(), "status": "DELETED"}
    audit = dict(zip(_fields(AUDIT_RECORD), (version, "DELETE", "version_number", version, None, None, actor, at.isoformat())))
    commit.publish(spark, path, {"record": record, "audit": audit}, before)


def snapshot_diff(v1: DataFrame, v2: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows added, removed or changed from one version to the next; null keys are equal."""
    a = v1.select(*keys, F.struct(*cols).alias("_a"))
    b = v2.select(*keys, F.struct(*cols).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    j = join_on(a, b, keys, "full").withColumn("change", change).where(F.col("change").isNotNull())
    pairs = []
    for c in cols:
        pairs += [F.col(f"_a.{c}").alias(f"old_{c}"), F.col(f"_b.{c}").alias(f"new_{c}")]
    return j.select(*keys, "change", *pairs)


def audit_counts(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Changes by module, actor or record, with the first and last time."""
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("n_changes"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def audit_last(log: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Last recorded value per record and field."""
    return log.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias("last_value"))
