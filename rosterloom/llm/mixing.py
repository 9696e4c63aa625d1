"""Mixing sources to target weights.

Every source gets a share of the mix by its weight, at most ``max_epochs`` times its own
size; what a capped source leaves is shared again by weight.  A source's documents
are put in the order of a seeded hash of their id and text, rows equal in both in the order of their rows.  The order is
cut into ranges of the hash, the ranges' sizes give each range its prefix sum, and only the one range in which
the budget ends is cut again by further digits, until it holds few documents; these are looked at
one by one.  So no source, however large, is ever in one task, and the plan that decides about all documents has
one row per source.

Defined cases: a null text has size 0; a null source is a source of its own and comes
last; a null id hashes as the empty text; an empty table gives no rows; rows equal in id and text
share their place in the order, and where the budget ends on them, as many are taken whole as fit, one in
part and the others not, so null and repeated ids meet the target like any; very long texts are counted in the JVM and
moved by no shuffle; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterloom.llm.common import landed, whole

WORDS = r"[^\x20\x09-\x0D]+"
RANGE_DIGITS = 3  # 16 ** 3 ranges of the hash per source, and of a range that is cut again
FEW = 100_000  # documents of a range that one task may look at
ROW_BITS = 33  # of a row number, those that count inside a partition


def n_words(text: str = "text") -> Column:
    return F.regexp_count(whole(text), F.lit(WORDS)).cast("bigint")


def hash_key(id_col: str, text_col: str, seed: str) -> Column:
    """The hash-random key of a document's id and text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(whole(text_col))))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", row: Column | None = None) -> DataFrame:
    """One row per document: id, source, size, the hash-random key and a number of the row."""
    number = F.monotonically_increasing_id() if row is None else row
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), hash_key(id_col, text_col, seed).alias("key"), number.alias("row")
    )


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """Water filling over (source, source_size): adds ``target``.

    Sources are filled in the order of the level at which they reach their cap; the
    first that the common level leaves below its cap ends the capped ones.  The windows
    run over one row per source.
    """
    by_code = W.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_code) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    base = sizes.select("*", weight.alias("_w"), (F.col("source_size") * F.lit(float(max_epochs))).alias("_cap"))
    filling = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    capped = F.coalesce(F.sum("_cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_w").over(filling.rowsBetween(0, W.unboundedFollowing))
    level = base.select("*", F.row_number().over(filling).alias("_place"), ((total - capped) / open_weight).alias("_level"))
    first = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_place", "_level"))).over(everything)["_level"]
    return level.select("*", first.alias("_first")).select(
        "source",
        "source_size",
        F.least(F.col("_cap"), F.coalesce(F.col("_first") * F.col("_w"), F.col("_cap"))).alias("target"),
    )


def _first_reaching(pieces: DataFrame, by: Sequence[str], order: str, words: str, wanted: str) -> DataFrame:
    """Of every ``by`` the piece, in order, in which the running sum of ``words`` reaches ``wanted``; adds ``before``."""
    before = F.coalesce(F.sum(words).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return pieces.select("*", before.alias("before")).where((F.col("before") < F.col(wanted)) & (F.col(wanted) <= F.col("before") + F.col(words)))


def mix_plan(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row per source: target, whole epochs, and the key, row and words at which the budget ends in its order.

    ``rows`` (landed) are read once for the sizes, then only by the range in which a budget ends.
    """
    digits = RANGE_DIGITS
    ranges = landed(rows.groupBy("source", F.substring("key", 1, digits).alias("piece")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "mix-ranges")
    plan = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    budget = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    plan = plan.select("*", epochs.alias("epochs"))
    plan = landed(plan.select("*", (budget - F.col("epochs") * F.col("source_size")).alias("rest")), "mix-targets")

    # the range in which each budget ends, cut again while it holds many documents
    wanted = plan.where("rest > 0").select(F.col("source").alias("_s"), F.col("rest").alias("left"))
    pieces = ranges.join(wanted, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    while True:
        ends = _first_reaching(pieces, ["source"], "piece", "words", "left")
        ends = landed(ends.select(F.col("source").alias("_s"), F.col("piece").alias("_p"), (F.col("left") - F.col("before")).alias("left"), F.col("n").alias("_n")), "mix-ends")
        inside = rows.join(ends, F.col("source").eqNullSafe(F.col("_s")) & (F.substring("key", 1, digits) == F.col("_p")))
        if digits > 32 - RANGE_DIGITS or not ends.where(F.col("_n") > FEW).head(1):
            break
        digits += RANGE_DIGITS
        pieces = inside.groupBy("source", F.substring("key", 1, digits).alias("piece"), "left").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))

    # the key on which it ends; its rows are equal, so it ends after ``whole_rows`` of them and in part of one more
    keys = inside.groupBy("source", "key", "left").agg(F.sum("size").alias("words"), F.max("size").alias("_size"))
    at = _first_reaching(keys, ["source"], "key", "words", "left").select(
        F.col("source").alias("_as"), F.col("key").alias("cut_key"), F.floor((F.col("left") - F.col("before")) / F.col("_size")).alias("whole_rows"),
        ((F.col("left") - F.col("before")) % F.col("_size")).alias("cut_take"),
    )
    at = landed(at, "mix-cuts")
    equal = rows.join(at, F.col("source").eqNullSafe(F.col("_as")) & (F.col("key") == F.col("cut_key"))).select("_as", "row", (F.col("whole_rows") + 1).alias("nth"))
    part = F.shiftright("row", ROW_BITS).alias("_part")
    parts = equal.groupBy("_as", part, "nth").agg(F.count(F.lit(1)).alias("n"))
    parts = _first_reaching(parts, ["_as"], "_part", "n", "nth").select(F.col("_as").alias("_es"), F.col("_part").alias("_ep"), (F.col("nth") - F.col("before")).alias("nth_here"))
    here = equal.join(parts, F.col("_as").eqNullSafe(F.col("_es")) & (F.shiftright("row", ROW_BITS) == F.col("_ep")))
    place = F.row_number().over(W.partitionBy("_as").orderBy("row"))
    row = here.select("_as", "row", "nth_here", place.alias("_place")).where(F.col("_place") == F.col("nth_here")).select(F.col("_as").alias("_rs"), F.col("row").alias("cut_row"))
    at = at.join(row, F.col("_as").eqNullSafe(F.col("_rs")), "left").drop("_rs", "whole_rows")
    return landed(plan.join(at, F.col("source").eqNullSafe(F.col("_as")), "left").drop("_as"), "mix-plan")


def taken(size: Column, key: Column, row: Column) -> Column:
    """Words that the mix takes of a document, by the row of its source in the plan."""
    in_last_key = F.when(F.col("cut_row").isNull() | (row < F.col("cut_row")), size).when(row == F.col("cut_row"), F.col("cut_take")).otherwise(F.lit(0))
    part = F.when(F.col("cut_key").isNull() | (key > F.col("cut_key")), F.lit(0)).when(key < F.col("cut_key"), size).otherwise(in_last_key)
    return (F.col("epochs") * size + part).cast("bigint")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, source, size, source_size, target, taken.  The sizes are counted once and landed."""
    rows = landed(sized(docs, id_col), "mix-sizes")
    plan = mix_plan(rows, weights, share, max_epochs).withColumnRenamed("source", "_ps")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_ps"))).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", taken(F.col("size"), F.col("key"), F.col("row")).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The documents themselves, whole, as often as the mix takes them (nearest whole number of times).

    Only the document on which a source's budget ends can differ from the word count.
    A document without words follows its place in the order.  Texts are not shuffled by key; a landed
    copy numbers the rows, so that rows equal in id and text are told apart.
    """
    mark = "_row"
    while mark.lower() in {c.lower() for c in docs.columns}:
        mark = f"_{mark}"
    copy = landed(docs.withColumn(mark, F.monotonically_increasing_id()), "mix-rows")
    plan = mix_plan(landed(sized(copy, id_col, source_col=source_col, row=F.col(mark)), "mix-sizes"), weights, share, max_epochs)
    plan = plan.withColumnRenamed("source", "plan_source")
    rows = copy.select(F.struct(*docs.columns).alias("whole_row"), hash_key(id_col, "text", "mix").alias("key"), F.col(source_col).alias("source"), F.col(mark).alias("row"), n_words().alias("size"))
    at_cut = F.when(F.col("cut_row").isNull() | (F.col("row") < F.col("cut_row")), 1).when((F.col("row") == F.col("cut_row")) & (2 * F.col("cut_take") >= F.col("size")), 1).otherwise(0)
    extra = F.when(F.col("cut_key").isNull() | (F.col("key") > F.col("cut_key")), 0).when(F.col("key") < F.col("cut_key"), 1).otherwise(at_cut)
    times = (F.col("epochs") + extra).cast("int")
    repeated = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).select("whole_row", F.explode(F.array_repeat(F.lit(0), times)))
    return repeated.select("whole_row.*")


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    from rosterloom.llm.common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
    SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
           source_size * CAST(2 AS DOUBLE) AS cap
    FROM s
), f AS (
    SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place,
              (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
               - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM w
), t AS (
    SELECT source, source_size,
           least(cap, coalesce(arg_min(level, place) FILTER (WHERE level * weight <= cap) OVER () * weight, cap)) AS target
    FROM f
), e AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t
), b AS (
    SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
           CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size AS rest,
           coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM b
"""
