"""One-partner pairing of findings, without loops over rows.

Equal keys pair by occurrence number.  Unequal ones are paired name by name in
rounds: an edge is taken when it is the best of both its names, with as many
copies as both sides have left.  The best remaining edge is always such an edge,
so every round makes progress and the result equals taking edges best first.
Edges of one score are ordered by a hash of their names: in name order all names of one
side would want the same partner and a round would settle one pair, in hash
order it settles a share of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.joins import join_on
from rosterloom.functions.skew import carry
from rosterloom.session import durable


def pair_by_occurrence(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str
) -> DataFrame:
    """n-th left row of a key with its n-th right row: (keys, left_id, right_id)."""
    l = carry(left.select(*keys, left_id), keys, [left_id], number="_n")
    r = carry(right.select(*keys, right_id), keys, [right_id], number="_n")
    return join_on(l, r, [*keys, "_n"]).drop("_n")


def assign_names(edges: DataFrame, block: Sequence[str], a_counts: DataFrame, b_counts: DataFrame) -> DataFrame:
    """Greedy assignment of copies along (block, a_name, b_name, score), low score first.

    Equal scores go by ``md5(a_name, U+0001, b_name)``, then by name.  Counts are (block, name, n).  Returns (block, a_name, b_name, score, a_from,
    b_from, n): copies a_from+1.. of a_name go with copies b_from+1.. of b_name.
    """
    ca = a_counts.select(*block, F.col("name").alias("a_name"), F.col("n").alias("a_left"), F.lit(0).cast("bigint").alias("a_used"))
    cb = b_counts.select(*block, F.col("name").alias("b_name"), F.col("n").alias("b_left"), F.lit(0).cast("bigint").alias("b_used"))
    open_edges = durable(edges.join(ca, [*block, "a_name"]).join(cb, [*block, "b_name"]))
    taken = None
    while True:
        tie = F.md5(F.concat("a_name", F.lit("\u0001"), "b_name"))
        rank = F.struct("score", tie.alias("tie"), "a_name", "b_name")
        best_a = open_edges.groupBy(*block, "a_name").agg(F.min(rank).alias("best")).select(*block, "best.*").drop("tie")
        best_b = open_edges.groupBy(*block, "b_name").agg(F.min(rank).alias("best")).select(*block, "best.*").drop("tie")
        both = [*block, "a_name", "b_name", "score"]
        mutual = best_a.join(best_b, both, "left_semi")
        now = durable(
            open_edges.join(mutual, both, "left_semi").select(
                *both, F.col("a_used").alias("a_from"), F.col("b_used").alias("b_from"),
                F.least("a_left", "b_left").alias("n"),
            )
        )
        taken = now if taken is None else taken.unionByName(now)
        if now.isEmpty():
            return taken
        spent_a = now.select(*block, "a_name", F.col("n").alias("_na"))
        spent_b = now.select(*block, "b_name", F.col("n").alias("_nb"))
        na, nb = F.coalesce("_na", F.lit(0)), F.coalesce("_nb", F.lit(0))
        open_edges = durable(
            open_edges.join(spent_a, [*block, "a_name"], "left")
            .join(spent_b, [*block, "b_name"], "left")
            .select(
                *both, (F.col("a_left") - na).alias("a_left"), (F.col("a_used") + na).alias("a_used"),
                (F.col("b_left") - nb).alias("b_left"), (F.col("b_used") + nb).alias("b_used"),
            )
            .where("a_left > 0 AND b_left > 0")
        )


def pair_rows(
    assigned: DataFrame, left: DataFrame, right: DataFrame, block: Sequence[str], name: str, left_id: str, right_id: str
) -> DataFrame:
    """Spread assigned copies over the rows: (block, left_id, right_id, score)."""
    l = carry(left.select(*block, F.col(name).alias("a_name"), left_id), [*block, "a_name"], [left_id], number="_ln")
    r = carry(right.select(*block, F.col(name).alias("b_name"), right_id), [*block, "b_name"], [right_id], number="_rn")
    spread = l.join(assigned, [*block, "a_name"]).where(
        (F.col("_ln") > F.col("a_from")) & (F.col("_ln") <= F.col("a_from") + F.col("n"))
    )
    spread = spread.withColumn("_rn", F.col("_ln") - F.col("a_from") + F.col("b_from"))
    return spread.join(r, [*block, "b_name", "_rn"]).select(*block, left_id, right_id, "score")


def name_counts(df: DataFrame, block: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*block, F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def score_of(similarity: Column) -> Column:
    return F.lit(1.0) - similarity
