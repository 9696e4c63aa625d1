"""Report sinks and loads into stored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.joins import join_on
from rosterloom.functions.skew import numbered_by_range
from rosterloom.functions.text import is_blank


def write_report(df: DataFrame, path: str, order: Sequence[str], fmt: str = "csv", by: str | None = None) -> None:
    """Findings, range-sorted, as a folder of files; never one file from one task."""
    writer = df.orderBy(*order).write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(by) if by else writer).save(path)


def write_sections(sections: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One dataset per section below ``path``, readable together by ``section``."""
    for name, df in sections.items():
        df.write.mode("errorifexists").format(fmt).save(f"{path}/section={name}")


def replace_load(target: DataFrame, new: DataFrame, owned: Column) -> DataFrame:
    """Target with the owner's rows replaced by ``new``; other rows untouched."""
    return target.where(~F.coalesce(owned, F.lit(False))).unionByName(new, allowMissingColumns=True)


def replace_partitions(new: DataFrame, path: str, owner: str) -> None:
    """Replace only the owners present in ``new`` in a table partitioned by owner.

    Spark swaps the partitions one after another; where a stopped load must never be seen in part, and a run is to be
    recorded with its rows, use ``commit.replace_owners``.
    """
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(owner).parquet(path)


def run_record(target: DataFrame, source: DataFrame, key: str, cols: Sequence[str], name: str) -> DataFrame:
    """One row describing a load: inserted, updated and skipped counts, status."""
    changed = F.lit(False)
    for c in cols:
        changed = changed | ~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    kind = F.when(F.col(f"t.{key}").isNull(), "inserted").when(changed, "updated").otherwise("skipped")
    both = source.alias("s").join(target.alias("t"), F.col(f"s.{key}") == F.col(f"t.{key}"), "left")
    counts = both.select(kind.alias("kind")).agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("inserted", "updated", "skipped")]
    )
    return counts.select(
        F.lit(name).alias("run_name"),
        "*",
        F.when(F.col("inserted") + F.col("updated") > 0, "APPLIED").otherwise("NO CHANGE").alias("status"),
    )


def record_run(record: DataFrame, path: str) -> None:
    """Append a run's record to the table of runs."""
    record.write.mode("append").parquet(path)


def upsert_dim(dim: DataFrame, names: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Dimension with the missing names appended under the next ids, in name order."""
    fresh = (
        names.where(~is_blank(F.col(name_col))).select(name_col).distinct().join(dim, name_col, "left_anti")
    )
    top = dim.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    added = numbered_by_range(fresh, [], [name_col], "_no").select(
        (top + F.col("_no")).cast("bigint").alias(id_col), name_col, F.lit(True).alias("is_new")
    )
    return dim.select(id_col, name_col, F.lit(False).alias("is_new")).unionByName(added)


def insert_new(target: DataFrame, src: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Source rows whose natural key is not stored yet, the first of each key; nulls in a key are equal."""
    rest = [c for c in src.columns if c not in keys]
    first = src.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return join_on(first, target.select(*keys).distinct(), keys, "left_anti").select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in rest]
    )


def upsert_fill(
    target: DataFrame, src: DataFrame, key: str, fill: Sequence[str], force: Sequence[str] = ()
) -> DataFrame:
    """Merge by key: fill blanks of ``fill``, overwrite ``force``, say what happened."""
    pick = {
        **{c: F.when(is_blank(F.col(f"t.{c}")), F.coalesce(f"s.{c}", f"t.{c}")).otherwise(F.col(f"t.{c}")) for c in fill},
        **{c: F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")) for c in force},
    }
    changed = F.lit(False)
    for c, v in pick.items():
        changed = changed | ~v.eqNullSafe(F.col(f"t.{c}"))
    action = (
        F.when(F.col(f"t.{key}").isNull(), "inserted")
        .when(F.col(f"s.{key}").isNull(), "kept")
        .when(changed, "updated")
        .otherwise("unchanged")
    )
    joined = target.alias("t").join(src.alias("s"), F.col(f"t.{key}") == F.col(f"s.{key}"), "full")
    return joined.select(
        F.coalesce(f"t.{key}", f"s.{key}").alias(key), *[v.alias(c) for c, v in pick.items()], action.alias("action")
    )
