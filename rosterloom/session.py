"""Session helpers: a local session for tests and bench, and durable cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def local_session(cpus: int | str = 8, shuffle: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rosterloom")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for durable data, named by ``spark.checkpoint.dir``.

    A machine-local folder is only ever used by a local session (tests, bench);
    on a cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    # a static setting cannot be put into a running session, so the folder is kept here, by application
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="rosterloom-")
    return _local_folders[app]


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


FORGET = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, forget: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, safe against lost executors.

    ``forget`` removes the files of the shuffles that made it once it is written; else they stay until the driver happens to
    collect its garbage, and those of all steps of a query add up.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    if not forget:
        return df.checkpoint(eager=True)
    was = spark.conf.get(FORGET, "false")
    spark.conf.set(FORGET, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own takes the setting
    finally:
        spark.conf.set(FORGET, was)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition a small set over all tasks before each row is expanded."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)
