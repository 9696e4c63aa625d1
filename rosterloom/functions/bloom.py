"""A Bloom filter as one array of longs, tested inside the scan of the large side, native in Spark.

The filter has a fixed greatest size, so it travels with every task at any size of the keys; where there are
more keys than it was made for, more foreign values pass, and the exact join behind it decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 10, 21  # powers of two; the most are 256 KB
BITS_A_KEY = 16
PROBES = 3


def _places(value: Column, bits: int) -> list[Column]:
    h = F.xxhash64(value)
    return [F.shiftrightunsigned(h, i * MOST_BITS).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(PROBES)]


def filter_of(keys: DataFrame, key: str, n: int) -> tuple[Column, Callable[[Column, Column], Column]]:
    """(filter, test): a scalar for the filter of about ``n`` keys, to be selected as a column, and ``test(that column, value)``."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_KEY * max(n, 1) - 1).bit_length()))
    set_bits = keys.select(F.explode(F.array(*_places(F.col(key), bits))).alias("_p"))
    words = set_bits.groupBy(F.shiftright("_p", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_p & 63 AS INT))")).alias("_b"))
    every = keys.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("_w"))
    full = every.join(words, "_w", "left").agg(F.array_sort(F.collect_list(F.struct("_w", F.coalesce("_b", F.lit(0)).alias("_b")))).alias("_f"))
    scalar = full.select(F.col("_f._b")).scalar()

    def test(column: Column, value: Column) -> Column:
        ok = F.lit(True)
        for p in _places(value, bits):
            word = F.get(column, F.shiftright(p, 6).cast("int"))
            ok = ok & (F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return ok

    return scalar, test
