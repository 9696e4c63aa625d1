"""Ordered (window-like) work that survives one key holding a third of all rows.

A plain window sends every row of a key to one task.  ``carry`` first learns from a sample which
keys fill more than one piece and where, by position, to cut them, whatever the type or spread of their
order.  It then is a two-level prefix scan: one exchange by (key, piece) and a window inside each
piece, while the rows of the cut keys alone are summarised to one row per piece; the summaries are
scanned and what the pieces before (or after) hold is brought to the rows of a piece.  A
piece is told by the values of a row alone, so the results do not depend on the sample.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIECE_ROWS = 1_000_000  # a key is left whole up to this many rows
SAMPLED = 60  # sampled rows per piece


def _same_keys(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(
        lambda a, b: a & b, [left[n].eqNullSafe(right[f"_r_{n}"]) for n in names]
    )


def _cuts(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int, least: int) -> DataFrame | None:
    """(key copies, ``_cuts``): where the keys that hold more than a piece are cut; None if there are none.

    Reads keys and order twice, without a shuffle: once to count, once to sample.  The sample has about
    ``SAMPLED`` rows a piece, so it grows with the number of pieces, not with the rows.
    """
    slim = df.select(*keys, *[c for c in order if c not in keys])
    rows = slim.count()
    piece = max(rows / pieces, least)
    if rows <= piece:
        return None
    sample = slim if rows <= SAMPLED * pieces else slim.where(F.rand(7) < SAMPLED / piece)
    share = min(1.0, SAMPLED / piece) if sample is not slim else 1.0
    step = max(1, round(piece * share))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    found = (
        sample.select("*", place.alias("_place"))
        .where((F.col("_place") > 1) & ((F.col("_place") - 1) % step == 0))
        .select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.struct(*order).alias("_cut"))
        .groupBy(*[f"_r_{k}" for k in keys])
        .agg(F.array_sort(F.collect_set("_cut")).alias("_cuts"))
    )
    got = found.collect()
    return df.sparkSession.createDataFrame(got, found.schema) if got else None


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    number: str | None = None,
    sums: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    lag: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    xors: dict[str, Column] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Running state per key in the order of ``order`` (nulls first, as in a window).

    ``number`` names a 1-based row number; ``sums`` are running totals up to and
    including the row; ``last`` the last non-null value up to and including the
    row; ``lag`` the value of the row before; ``following`` the first non-null value from the
    row on; ``xors`` are running bitwise exclusive ors of longs.  Rows that are equal in keys and order stay in one piece, so ``order`` should end in
    a unique column.  All states of a call share one cut and one exchange; without keys
    all rows are one key, which is always cut.

    ``ranges`` is the number of pieces that all rows make; by default the shuffle partitions, with at least
    ``PIECE_ROWS`` rows a piece.  Pieces of cut keys, their summaries and their state rows are at most as many.
    """
    sums, last, lag, following, xors = sums or {}, last or {}, lag or {}, following or {}, xors or {}
    values = {**sums, **last, **lag, **following, **xors}
    kept = [c for c in df.columns if c != number and c not in values]
    base = df.withColumns({f"_v_{out}": v for out, v in values.items()}) if values else df
    if not keys:
        base, keys = base.withColumn("_all", F.lit(0)), ["_all"]
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(base, keys, order, n, 1 if ranges or keys == ["_all"] else PIECE_ROWS)
    whole = [*keys, "_piece"] if cuts is not None else [*keys]
    if cuts is not None:
        place = F.struct(*order)
        piece = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= place)), F.lit(0)).alias("_piece")
        copies = [f"_r_{k}" for k in keys]
        if keys == ["_all"]:
            base = cut_rows = base.select("*", cuts.select("_cuts").scalar().alias("_cuts")).select(*base.columns, piece)
        else:
            cut_rows = base.join(F.broadcast(cuts), _same_keys(base, cuts, keys)).select(*base.columns, piece)
            base = base.join(F.broadcast(cuts), _same_keys(base, cuts, keys), "left").select(*base.columns, piece)

    inside = W.partitionBy(*whole).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    # from the end backwards: a frame that reaches to the last row is computed anew for every row, the square of a piece
    onward = W.partitionBy(*whole).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(W.unboundedPreceding, 0)
    local = {"_l_row": F.row_number().over(inside).cast("bigint")}
    local |= {o: F.sum(f"_v_{o}").over(upto) for o in sums}
    local |= {o: F.bit_xor(f"_v_{o}").over(upto) for o in xors}
    local |= {o: F.last(f"_v_{o}", ignorenulls=True).over(upto) for o in last}
    local |= {o: F.lag(f"_v_{o}").over(inside) for o in lag}
    local |= {o: F.last(f"_v_{o}", ignorenulls=True).over(onward) for o in following}
    rows = base.select(*whole, *[c for c in kept if c not in whole], *[e.alias(f"_l_{o}" if o in values else o) for o, e in local.items()])
    if cuts is None:
        out = [F.col("_l_row").alias(number)] if number else []
        out += [F.coalesce(f"_l_{o}", F.lit(0)).alias(o) for o in (*sums, *xors)]
        return rows.select(*kept, *out, *[F.col(f"_l_{o}").alias(o) for o in (*last, *lag, *following)])

    # one row per piece of a cut key: what it holds, then what the pieces before and after it hold
    some = lambda o: F.when(F.col(f"_v_{o}").isNotNull(), place)
    held = [F.count(F.lit(1)).alias("_rows"), *[F.sum(f"_v_{o}").alias(f"_h_{o}") for o in sums], *[F.bit_xor(f"_v_{o}").alias(f"_h_{o}") for o in xors]]
    held += [F.max_by(f"_v_{o}", some(o)).alias(f"_h_{o}") for o in last]
    held += [F.max_by(F.struct(f"_v_{o}"), place).alias(f"_h_{o}") for o in lag]
    held += [F.min_by(f"_v_{o}", some(o)).alias(f"_h_{o}") for o in following]
    summary = cut_rows.groupBy(*whole).agg(*held)
    along = W.partitionBy(*keys).orderBy("_piece")
    before, after = along.rowsBetween(W.unboundedPreceding, -1), along.rowsBetween(1, W.unboundedFollowing)
    brought = {"_b_row": F.sum("_rows").over(before)}
    brought |= {f"_b_{o}": F.sum(f"_h_{o}").over(before) for o in sums}
    brought |= {f"_b_{o}": F.bit_xor(f"_h_{o}").over(before) for o in xors}
    brought |= {f"_b_{o}": F.last(f"_h_{o}", ignorenulls=True).over(before) for o in last}
    brought |= {f"_b_{o}": F.lag(f"_h_{o}").over(along)[f"_v_{o}"] for o in lag}
    brought |= {f"_b_{o}": F.first(f"_h_{o}", ignorenulls=True).over(after) for o in following}
    state = summary.select(*[F.col(c).alias(f"_r_{c}") for c in whole], *[e.alias(o) for o, e in brought.items()])
    got = rows.join(F.broadcast(state), _same_keys(rows, state, whole), "left").drop(*copies, "_r__piece")

    out = [(F.col("_l_row") + F.coalesce("_b_row", F.lit(0))).cast("bigint").alias(number)] if number else []
    out += [(F.coalesce(f"_l_{o}", F.lit(0)) + F.coalesce(f"_b_{o}", F.lit(0))).alias(o) for o in sums]
    out += [F.coalesce(f"_l_{o}", F.lit(0)).bitwiseXOR(F.coalesce(f"_b_{o}", F.lit(0))).alias(o) for o in xors]
    out += [F.coalesce(f"_l_{o}", f"_b_{o}").alias(o) for o in (*last, *following)]
    out += [F.when(F.col("_l_row") == 1, F.col(f"_b_{o}")).otherwise(F.col(f"_l_{o}")).alias(o) for o in lag]
    return got.select(*kept, *out)


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], unique: str, salts: int = 64, how: str = "inner") -> DataFrame:
    """Equi join on keys with few distinct values, such as a status.

    Every key of ``big`` is spread over ``salts`` tasks by its unique column; the
    rows of ``small`` (rules, lists) are repeated once per salt.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(unique), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def numbered_by_range(
    df: DataFrame, section: Sequence[str], order: Sequence[str], out: str
) -> DataFrame:
    """1-based number within each section for any sort order, text included.

    Rows are range-partitioned by (section, order); a row's number is its offset
    inside its partition plus the section's rows in earlier partitions.  The
    ranges come from a sample, so the partitioned rows are checkpointed once and
    every later stage reads the same cut.  ``order`` should end in a unique column.
    """
    from rosterloom.session import durable

    cols = df.columns
    cut = (
        df.repartitionByRange(*section, *order)
        .sortWithinPartitions(*section, *order)
        .withColumn("_p", F.spark_partition_id())
        .withColumn("_m", F.monotonically_increasing_id())
    )
    cut = durable(cut)
    keys = [*section, "_p"]
    parts = cut.groupBy(*keys).agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # one row per (section, partition); without a section this is one row per partition
    before = W.partitionBy(*section).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
    )
    return cut.join(parts, _same_keys(cut, parts, keys)).select(
        *cols, (F.col("_m") - F.col("_first") + F.col("_before") + 1).cast("bigint").alias(out)
    )
