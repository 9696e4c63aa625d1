"""Connected components of a link table by alternating stars, as DataFrame rounds.

In a round every node first tells its larger neighbours, then its smaller ones, of the smallest
neighbour it has.  The links shrink to one star per component in a number of rounds that
grows with the logarithm of the largest component.  Each round is written to the shared
folder, so a lost executor repeats one round at most, and only counts reach the driver.  A round's copy goes when
the next one is written.  A table without links has no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.common import forget, landed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; the root is the smallest node of the component.

    Links of a node to itself and links without an end are not links.
    """
    star = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    star = landed(star, "links")
    seen = None
    while True:
        either = star.union(star.select("v", "u"))
        least = either.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = either.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = landed(large, "links")
        forget(star)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        beside = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = landed(beside.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        forget(large)
        state = star.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).head()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
