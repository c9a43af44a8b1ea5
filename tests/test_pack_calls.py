import pytest

from codequarry.operators import resolve
from codequarry.plans import pack
from codequarry.sources import tables
from pyspark.sql import Window
from pyspark.sql import functions as F
from tests.test_file_calls import documents


def test_call_edges_of_file_rows(spark):
    """Each distinct called name of each file was dealt out; the edges are the same without."""
    f = documents(spark)
    d, c = tables.definitions(f), tables.calls(f)
    paths = sorted(r["path"] for r in f.collect())
    links = [("documents", a, paths[(k * 7 + j) % len(paths)]) for k, a in enumerate(paths) for j in (1, 3)]
    imported = spark.createDataFrame(links, "repo_key string, src string, dst string")
    wanted = sorted(map(tuple, resolve.call_edges(c, d, imported).collect()))
    got = sorted(map(tuple, resolve.call_edges_of(lambda met: tables.nested(f, met), d, imported).select("repo_key", "src", "dst").collect()))
    assert len(wanted) > 20 and got == wanted


@pytest.mark.parametrize("callers", [2, 1000])
def test_top_calls_look_at_first_callers(spark, monkeypatch, callers):
    monkeypatch.setattr(pack, "CALLERS", callers)
    f = documents(spark, 12)
    d, c = tables.definitions(f), tables.calls(f)
    ranked = d.withColumn("rank", F.row_number().over(Window.orderBy(F.xxhash64("path", "def_ord"))))
    best = ranked.groupBy("path", "name").agg(F.max("rank").alias("rank")).withColumnRenamed("name", "from_name")
    pairs = c.join(best, ["path", "from_name"]).join(d.select(F.col("name").alias("to_name")).distinct(), "to_name").groupBy("from_name", "to_name").agg(F.min("rank").alias("rank"), F.min("call_ord").alias("ord"))
    wanted = [(r[0], r[1]) for r in pairs.orderBy("rank", "ord", "from_name", "to_name").limit(25).collect()]
    assert len(wanted) == 25 and pack.top_calls(pack.Repository("r", f, d, c, None), ranked, 25) == wanted
