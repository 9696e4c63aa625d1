"""Null keys are equal to each other wherever two sides are compared."""

from pyspark.sql import functions as F

from rosterloom.functions.joins import join_on
from rosterloom.operators import correct, dedupe, pairing
from rosterloom.operators import reconcile as rc


def sides(spark):
    schema = "org long, k string, id long, title string, mobile string, email string"
    a = spark.createDataFrame([(None, "x", 1, "Chief", "9800000001", None), (1, None, 2, "Head", "", "a@b.org"), (2, "z", 3, "t", None, None)], schema)
    b = spark.createDataFrame([(None, "x", 11, "Chief", "9800000002", None), (1, None, 12, "Clerk", "", "a@b.org"), (3, "z", 13, "t", None, None)], schema)
    return a, b


def test_join_on(spark, rows):
    a, b = sides(spark)
    both = join_on(a.select("org", "k", "id"), b.select("org", "k", F.col("id").alias("bid")), ["org", "k"], "full")
    assert both.columns == ["org", "k", "id", "bid"]
    assert rows(both, "id", "bid") == [(None, 13), (1, 11), (2, 12), (3, None)]
    assert rows(join_on(a, b, ["org", "k"], "left_anti"), "id") == [(3,)]
    assert join_on(a, a, "k").columns == ["k", "org", "id", "title", "mobile", "email"] + ["org", "id", "title", "mobile", "email"]


def test_comparisons(spark, rows):
    a, b = sides(spark)
    diff = rc.field_diff(a, b, ["org", "k"], "id", [rc.Field("title")])
    assert rows(diff, "org", "k", "match") == [(None, "x", "yes"), (1, None, "no"), (2, "z", "a_only"), (3, "z", "b_only")]
    issues = rc.compare_entities(a, b, ["org", "k"], "id", title="title", phone="mobile", email="email")
    assert rows(issues, "org", "issue") == [(None, "phone"), (1, "title"), (2, "missing"), (3, "extra")]
    sets = {"phones": (F.array("mobile"), F.array("mobile"))}
    assert rows(rc.set_diff(a, b, ["org", "k"], sets), "org", "n_a_only", "n_b_only") == [(None, 1, 1)]
    assert rows(rc.missing_rows(a, b, ["org", "k"], "id"), "org", "k") == [(2, "z")]
    assert rows(correct.propose(a, b, ["org", "k"], "id", "id", "title", "mobile", "email"), "org", "field", "action") == [
        (None, "mobile", "manual"), (1, "title", "update"), (2, "(record)", "insert"),
    ]
    assert rows(rc.wrong_group(a.where("k IS NOT NULL"), b.where("k IS NOT NULL"), "org", "k", "id"), "id", "status") == [(13, "wrong_group")]


def test_pairs_and_duplicates(spark, rows):
    a, b = sides(spark)
    assert rows(pairing.pair_by_occurrence(a.select("org", F.col("id").alias("l")), b.select("org", F.col("id").alias("r")), ["org"], "l", "r"), "l", "r") == [(1, 11), (2, 12)]
    twice = a.union(a.withColumn("id", F.col("id") + 100))
    left = dedupe.near_dups(twice, twice.where("id = 3"), ["org", "k"], "id")
    assert sorted(r["id"] for r in left.collect()) == [1, 2, 101, 102]
    donors = b.withColumnRenamed("id", "bid").withColumn("k", F.coalesce("k", F.lit("name")))
    need = a.withColumn("k", F.coalesce("k", F.lit("name"))).withColumn("mobile", F.lit(""))
    got = dedupe.backfill(need, donors, "org", "k", "title", ["mobile"], "id", "bid")
    assert rows(got, "id", "donor_id", "proposed_value") == [(1, 11, "9800000002")]
