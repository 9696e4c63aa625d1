"""Loads with one commit point: rows are staged first, then one manifest file makes them count.

A stored folder has ``data/<id>`` (staged rows, never changed) and ``manifests/<number>.json``.  A commit writes its rows, then
publishes the next manifest by a rename that fails if the number is taken, which is atomic where renames are (HDFS, local
and mounted disks; an object store needs a committer with conditional puts).  Readers follow manifests only: a load
that stops anywhere before the rename leaves rows that nobody reads, one that stops after it is complete.  Of two writers
that start from one state, the second is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another commit has taken the number."""


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _hadoop(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def latest(spark: SparkSession, path: str) -> int:
    """Number of the last commit; 0 before the first."""
    return max((int(n[:-5]) for n in _listed(spark, f"{path}/manifests") if n.endswith(".json") and not n.startswith(".")), default=0)


def stage(rows: DataFrame, path: str, by: Sequence[str] = ()) -> str:
    """Write rows to a folder of their own and return its name below ``path``; they do not count yet."""
    name = f"data/{uuid.uuid4().hex}"
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/{name}")
    return name


def publish(spark: SparkSession, path: str, manifest: dict, after: int) -> int:
    """Make the manifest the commit after number ``after``."""
    number = after + 1
    body = json.dumps({"number": number, **manifest}, default=str).encode()
    draft, fs = _hadoop(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(body))
    out.close()
    final, _ = _hadoop(spark, f"{path}/manifests/{number:08d}.json")
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), plain)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise Conflict(f"commit {number} of {path} is taken") from None
        raise
    return number


def manifests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All manifests as rows (``number`` and the fields of ``schema``); none before the first commit."""
    schema = f"number bigint, {schema}"
    return spark.read.schema(schema).json(f"{path}/manifests") if latest(spark, path) else spark.createDataFrame([], schema)


def manifest(spark: SparkSession, path: str, number: int) -> dict:
    """One manifest, which the driver reads."""
    if not number:
        return {}
    return json.loads(spark.read.text(f"{path}/manifests/{number:08d}.json").head()[0])


OWNERS = "run struct<run_name string, inserted bigint, updated bigint, skipped bigint, status string>"


def replace_owners(new: DataFrame, path: str, owner: str, run: DataFrame | None = None) -> int:
    """Replace the rows of the owners present in ``new``, and with them record the run (one row of ``run_record``).

    The manifest names a folder for every owner, so it grows with the owners; folders of other owners are kept as they are.
    """
    spark = new.sparkSession
    before = latest(spark, path)
    parts = dict(manifest(spark, path, before).get("parts", {}))
    staged = stage(new, path, [owner])
    parts.update({name: staged for name in _listed(spark, f"{path}/{staged}") if name.startswith(f"{owner}=")})
    row = run.head().asDict() if run is not None else None
    return publish(spark, path, {"parts": parts, "run": row}, before)


def read_owners(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that the last commit stands for."""
    by_folder: dict[str, list[str]] = {}
    for name, staged in manifest(spark, path, latest(spark, path)).get("parts", {}).items():
        by_folder.setdefault(staged, []).append(f"{path}/{staged}/{name}")
    out = spark.createDataFrame([], schema)
    for staged, folders in sorted(by_folder.items()):
        out = out.unionByName(spark.read.schema(schema).option("basePath", f"{path}/{staged}").parquet(*folders))
    return out


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Run records in the order of their commits."""
    return manifests(spark, path, OWNERS).where(F.col("run").isNotNull()).select("number", "run.*")
