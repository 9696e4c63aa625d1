"""Joins on keys in which null equals null, as in the tuples that reconciliation compares; sides that are not broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Like ``left.join(right, keys, how)``, but null keys meet: keys first, then the columns of both sides."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    # new names on the right, so that sides that come from one table stay apart
    r = right.select(*[F.col(c).alias(f"_r_{c}") for c in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    joined = left.join(r, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    key = (lambda k: F.coalesce(k, f"_r_{k}").alias(k)) if how == "full" else F.col
    rest = [c for c in left.columns if c not in keys]
    return joined.select(*map(key, keys), *rest, *[F.col(f"_r_{c}").alias(c) for c in right.columns if c not in keys])


def shuffled(df: DataFrame) -> DataFrame:
    """A side that meets the other by a shuffle, never whole in the driver.

    Spark tells the size of checkpointed, exploded or grouped rows from the compressed files they came from, so millions of names
    pass for a table small enough to be broadcast.
    """
    return df.hint("merge")
