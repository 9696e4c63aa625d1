"""Chunked running state equals one plain window, also when a key is cut into many chunks."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterloom.functions.skew import _cuts, carry, numbered_by_range, salted_join
from rosterloom.operators import history as hs
from rosterloom.operators import segment as sg


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else None if i % 97 == 0 else f"k{i % 40}"
        rows.append((key, rng.randrange(5000) * 3, i, rng.choice([None, "x", "y", "z"]), rng.random() < 0.2))
    return spark.createDataFrame(rows, "k string, pos long, id long, v string, flag boolean").repartition(5).cache()


def expected(df):
    w = W.partitionBy("k").orderBy("pos", "id")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    return df.select(
        "id",
        F.row_number().over(w).cast("bigint").alias("no"),
        F.coalesce(F.sum(F.col("flag").cast("bigint")).over(upto), F.lit(0)).alias("total"),
        F.last("v", ignorenulls=True).over(upto).alias("seen"),
        F.lag("v").over(w).alias("before"),
    )


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_carry_equals_window(data, rows, ranges):
    got = carry(
        data, ["k"], ["pos", "id"], number="no", sums={"total": F.col("flag").cast("bigint")},
        last={"seen": F.col("v")}, lag={"before": F.col("v")}, ranges=ranges,
    )
    assert rows(got, "id", "no", "total", "seen", "before") == rows(expected(data))


ORDERS = {
    "null": "CASE WHEN id % 5 > 0 THEN pos END",
    "tied": "id % 3",
    "negative": "pos - 9000",
    "descending": "-pos",
    "clustered": "CASE WHEN id % 50 = 0 THEN pos * 1000000 ELSE pos % 7 END",
    "text": "'t' || CAST(pos % 1000 AS STRING)",
}


@pytest.mark.parametrize("kind", ORDERS)
def test_carry_of_any_order(data, rows, kind):
    df = data.withColumn("pos", F.expr(ORDERS[kind]))
    got = carry(df, ["k"], ["pos", "id"], number="no", sums={"total": F.col("flag").cast("bigint")}, last={"seen": F.col("v")}, lag={"before": F.col("v")}, ranges=17)
    assert rows(got, "id", "no", "total", "seen", "before") == rows(expected(df))


def test_carry_cuts_by_position(spark):
    """One far value does not leave a hot key in one piece; an exchange per cut; state rows linear in pieces."""
    df = spark.createDataFrame([("hot", i if i else 10**15) for i in range(5000)] + [(f"k{i}", i) for i in range(50)], "k string, pos long").repartition(6)
    cuts = _cuts(df, ["k"], ["pos"], 20, 1).collect()
    assert [c["_r_k"] for c in cuts] == ["hot"] and 15 <= len(cuts[0]["_cuts"]) <= 25
    at = [c["pos"] for c in cuts[0]["_cuts"]]
    assert max(b - a for a, b in zip([0, *at], [*at, 5000])) <= 3 * 5050 / 20
    got = carry(df, ["k"], ["pos"], number="no", ranges=20)
    assert got.where("k = 'hot'").agg(F.count_distinct("no"), F.max("no")).head() == (5000, 5000)
    assert _cuts(df, ["k"], ["pos"], 1, 1) is None


def test_carry_of_small_keys_is_one_exchange(data):
    got = carry(data, ["k"], ["pos", "id"], number="no", last={"seen": F.col("v")}, following={"next": F.col("v")})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("ranges", [None, 1, 9, 60])
def test_following_equals_window(data, rows, ranges):
    w = W.partitionBy("k").orderBy("pos", "id").rowsBetween(0, W.unboundedFollowing)
    wanted = rows(data.select("id", F.first("v", ignorenulls=True).over(w).alias("next")))
    assert rows(carry(data, ["k"], ["pos", "id"], following={"next": F.col("v")}, ranges=ranges), "id", "next") == wanted


@pytest.mark.parametrize("ranges", [None, 9])
def test_following_is_linear(data, ranges):
    """A frame from a row to the end of its piece is computed anew for every row; only the summaries, a row a piece, may have one."""
    got = carry(data, ["k"], ["pos", "id"], number="no", following={"next": F.col("v")}, ranges=ranges)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    inside = [line for line in plan.splitlines() if "_l_next" in line and "Window" in line]
    assert inside and not any("unboundedfollowing" in line for line in inside)


@pytest.mark.parametrize("ranges", [None, 13])
def test_carry_without_keys_and_of_nothing(data, rows, ranges):
    got = carry(data, [], ["pos", "id"], number="no", sums={"total": F.col("id")}, xors={"signs": F.xxhash64("id")}, ranges=ranges)
    w = W.orderBy("pos", "id")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    wanted = data.select("id", F.row_number().over(w).cast("bigint").alias("no"), F.sum("id").over(upto), F.bit_xor(F.xxhash64("id")).over(upto))
    assert rows(got, "id", "no", "total", "signs") == rows(wanted)
    assert carry(data.where("false"), ["k"], ["pos"], number="no", ranges=ranges).count() == 0


def test_numbered_by_range(data, rows):
    got = numbered_by_range(data, ["k"], ["v", "id"], "no")
    w = W.partitionBy("k").orderBy("v", "id")
    assert rows(got, "id", "no") == rows(data.select("id", F.row_number().over(w).cast("bigint").alias("no")))
    whole = numbered_by_range(data, [], ["v", "id"], "no")
    assert sorted(r.no for r in whole.collect()) == list(range(1, 901))


def test_salted_join(data, spark, rows):
    small = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, w int")
    assert rows(salted_join(data, small, ["k"], "id", 5), "id", "w") == rows(data.join(small, "k"), "id", "w")


def test_fill_heading_over_chunks(spark, rows):
    blocks = spark.createDataFrame(
        [("d", i, i % 10 == 3, f"t{i}") for i in range(60)] + [("e", 1, False, "a"), ("e", 2, True, "b")],
        "doc string, no long, h boolean, text string",
    )
    one = sg.fill_heading(blocks, "doc", "no", F.col("h"), "text")
    cut = sg.fill_heading(blocks, "doc", "no", F.col("h"), "text", ranges=8)
    assert rows(cut, "doc", "no", "heading") == rows(one, "doc", "no", "heading")
    assert ("e", 1, None) in rows(cut, "doc", "no", "heading")


def test_apply_status_over_chunks(spark, rows):
    rng = random.Random(3)
    events = spark.createDataFrame(
        [(i, i % 2, rng.choice(["ACTIVE", "RETIRED", "ON LEAVE", "nonsense"]), 1_000_000 * i) for i in range(200)],
        "event_id long, person_id long, new_status string, us long",
    ).withColumn("ts", F.timestamp_micros("us"))
    people = spark.createDataFrame([(0, "ACTIVE"), (1, "RETIRED")], "person_id long, status string")
    one = hs.apply_status(events, people)
    cut = hs.apply_status(events, people, ranges=9)
    assert rows(cut, "event_id", "old_status", "new_status") == rows(one, "event_id", "old_status", "new_status")
