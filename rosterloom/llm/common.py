"""What the operators of this folder share: texts, landed tables, by-value workers, block pairs."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.session import run_dir, shared_dir

BROADCAST_ROWS = 200_000  # a side is hinted for broadcast only when it was counted and is not above this


def by_value(module: str) -> None:
    """Let the functions of a module travel with the task, so workers need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def worker_store(name: str) -> dict:
    """A dict that the Python worker keeps from task to task (functions shipped by value lose their globals).

    A worker keeps one: asking for another name forgets the dict of the operator before.
    """
    import sys
    import types

    kept = sys.modules.setdefault("_corpus_worker_store", types.ModuleType("_corpus_worker_store"))
    if getattr(kept, "name", None) != name:
        kept.name, kept.store = name, {}
    return kept.store


by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """The whole text; a null text is an empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def landed(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: rows that several steps use are made once and outlive executors."""
    spark = df.sparkSession
    path = run_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a landed copy that nothing reads any more; only folders that ``landed`` has made are touched."""
    spark = df.sparkSession
    top = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    home = fs.makeQualified(top).toUri().getPath().rstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if place.toUri().getPath().rsplit("/", 1)[0].rstrip("/") == home:
            fs.delete(place, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (landed, so counting reads no data) with a broadcast hint when its counted rows allow it."""
    return F.broadcast(df) if df.count() <= rows else df


def same(left: DataFrame, right: DataFrame, names: Sequence[str], prefix: str = "_r_") -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[f"{prefix}{n}"])
    return cond


HOT_ROWS, HOT_KEYS = 10_000, 100_000  # a key of more rows than both allow is hot; so at most HOT_KEYS keys are


def hot_limit(total: int) -> int:
    """Keys with more rows than this number less than ``HOT_KEYS`` among ``total`` rows."""
    return max(HOT_ROWS, total // HOT_KEYS)


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], n: str, total: int, spread: str) -> DataFrame:
    """Left join of rows with one row per key, where one key may hold a third of all rows.

    ``groups`` (landed) has in ``n`` how many of the ``total`` rows a key has.  Keys above ``hot_limit`` are
    broadcast, as they are few at any size; the others are shuffled.  Rows of hot keys, which need no partner
    there, are dealt out by a hash of ``spread``.  Null keys have no partner.
    """
    values = [c for c in groups.columns if c not in (*keys, n)]
    limit = hot_limit(total)
    side = lambda df, mark: df.select(*[F.col(c).alias(f"{mark}{c}") for c in (*keys, *values)])
    hot = side(groups.where(F.col(n) > limit), "_h_").withColumn("_hot", F.lit(True))
    cold = side(groups.where(F.col(n) <= limit), "_c_").withColumn("_c_salt", F.lit(0).cast("bigint"))
    on = lambda left, right, mark: [left[k] == right[f"{mark}{k}"] for k in keys]
    settled = rows.join(F.broadcast(hot), on(rows, hot, "_h_"), "left")
    alone = F.col("_hot").isNotNull() | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    settled = settled.withColumn("_salt", F.when(alone, F.xxhash64(spread).bitwiseOR(F.lit(1))).otherwise(F.lit(0)).cast("bigint"))
    both = settled.join(cold, [*on(settled, cold, "_c_"), settled["_salt"] == cold["_c_salt"]], "left")
    return both.select(*rows.columns, *[F.coalesce(f"_h_{v}", f"_c_{v}").alias(v) for v in values])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_pairs(rows: DataFrame, bucket: Sequence[str], member: str, block: int) -> DataFrame:
    """Spread the members of every bucket over groups in which all of its pairs meet once.

    A bucket of up to ``block`` members is one group (0, 0).  A larger one is cut by a
    hash of the member into k blocks of about that size, and each member goes to the
    k groups (i, j), i <= j, that hold its block; a pair of two blocks meets in one group
    only, and a pair inside a block is to be compared in the group (i, i) alone.  No
    group holds much more than ``2 * block`` rows, however large a bucket is.
    Adds ``_i``, ``_j`` (the group) and ``_b`` (the member's block).
    """
    sizes = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    rows = rows.join(sizes, list(bucket))
    k = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    rows = rows.withColumn("_k", k).withColumn("_b", F.pmod(F.xxhash64(member), F.col("_k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_o")
    return rows.select("*", other).select(
        *[c for c in rows.columns if c not in ("_n", "_k")],
        F.least("_b", "_o").alias("_i"),
        F.greatest("_b", "_o").alias("_j"),
    )
