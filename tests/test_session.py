"""The library starts on a stock Spark, where no shared folder is set."""

import os
import re
import subprocess
import sys
import time

from rosterloom.plans import bind_contacts
from rosterloom.plans.tables import Tables

SCRIPT = """
from rosterloom.session import durable, local_session, run_dir, shared_dir
spark = local_session(2, shuffle=2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_dir(spark) == shared_dir(spark) and run_dir(spark, "x").startswith(shared_dir(spark))
df = durable(spark.range(10).selectExpr("id % 3 AS k", "id"))
from rosterloom.functions.skew import numbered_by_range
assert sorted(r.n for r in numbered_by_range(df, [], ["k", "id"], "n").collect()) == list(range(1, 11))
print("started")
"""


def test_starts_without_a_named_folder(tmp_path):
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join([home, os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=180)
    assert "started" in done.stdout, done.stderr[-2000:]


def test_settled_rules_leave_no_shuffle_files(spark, tmp_path):
    """what made the rules of the lists is removed from the disks once they are written, not when the driver collects its garbage."""
    made = {
        "supplier": ([(i, i % 25, i * 100.0) for i in range(90)], "s_suppkey long, s_nationkey int, s_acctbal double"),
        "orders": ([(i, i % 40) for i in range(300)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(i % 300, i % 90, float(i % 51)) for i in range(900)], "l_orderkey long, l_suppkey long, l_quantity double"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+", disk.getAllFiles().mkString(" ")))
    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    found = bind_contacts._rules(Tables(spark, str(tmp_path)))
    until = time.time() + 20
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    changes = found.where("filter_type IN ('INCLUDE_EMPLOYEE', 'EXCLUDE_EMPLOYEE')")
    of = lambda quantity: "EXCLUDE_EMPLOYEE" if quantity == 50 else "INCLUDE_EMPLOYEE"
    want = {(i % 90, of(i % 51), i % 300 % 40) for i in range(900)}
    assert sorted(map(tuple, changes.select("list_id", "filter_type", "person_id").collect())) == sorted(want)
