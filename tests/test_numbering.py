import random
import subprocess
import sys

from pyspark.sql import functions as F

from codequarry.operators import numbering
from codequarry.storage import Tables


def test_dense_ids_have_no_gaps(spark):
    out = numbering.dense_ids(spark.range(0, 1000, 1, 13).filter("id % 3 <> 1"), "n", Tables(spark, "t").write).collect()
    assert sorted(r["n"] for r in out) == list(range(len(out))) and len({r["id"] for r in out}) == len(out)


def test_numbers_within_groups_and_over_all(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), rng.choice([None, *range(50)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, id int")
    order = [F.col("x").asc_nulls_first(), F.col("id").asc()]
    w = Tables(spark, "t").write
    by_group = {r["id"]: r["row"] for r in numbering.numbered(df, order, w, by=["g"]).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for g in {r[0] for r in rows}:
        assert [by_group[r[2]] for r in sorted((r for r in rows if r[0] == g), key=key)] == list(range(sum(r[0] == g for r in rows)))
    over_all = {r["id"]: r["row"] for r in numbering.numbered(df, order, w).collect()}
    assert [over_all[r[2]] for r in sorted(rows, key=key)] == list(range(len(rows)))


def test_running_totals_across_tasks(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, *range(-5, 20)]), 1) for i in range(2000)]
    out = {r["id"]: (r["run_v"], r["run_one"]) for r in numbering.running(spark.createDataFrame(rows, "id int, v long, one long").repartition(7), [F.col("id").asc()], ["v", "one"], Tables(spark, "t").write).collect()}
    total = 0
    for i, v, _ in rows:
        total += v or 0
        assert out[i] == (total, i + 1)


def test_no_rows(spark):
    w, none = Tables(spark, "t").write, spark.createDataFrame([], "g string, x long")
    assert numbering.numbered(none, [F.col("x").asc()], w, by=["g"]).count() == 0
    assert numbering.running(none, [F.col("x").asc()], ["x"], w).count() == 0


EMPTY_CONF = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from codequarry import registry
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
assert "spark.checkpoint.dir" not in dict(spark.sparkContext.getConf().getAll())
for name in {names!r}:
    print(name, registry.queries()[name](spark, {sf!r}).count())
print("DONE")
"""


def test_a_session_without_a_checkpoint_folder(sf, tmp_path):
    """Spark's own defaults are left out by an empty configuration folder."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = EMPTY_CONF.format(root=root, names=("pagerank_nations", "scc_members"), sf=sf)
    got = subprocess.run([sys.executable, "-c", code], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}, capture_output=True, text=True, timeout=600)
    assert "DONE" in got.stdout, got.stderr[-2000:]
