from pyspark.sql import functions as F

from codequarry.sources import tables


def test_definitions_are_made_in_the_row_of_their_file(spark):
    f = spark.createDataFrame([("r", "a", "Xx one\n\n  12\nyy two\n"), ("r", "b", ""), ("r", "c", None), ("r", "d", "z"), ("r", "e", "1\nq\n2\n3")], "repo_key string, path string, text string")
    got = tables.definitions(f)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tables._shared_definitions(f).collect()))


def test_definitions_of_files_that_share_a_path(spark):
    f = spark.createDataFrame([("r", "a", "x\ny"), ("r", "a", "1\n2\nk"), ("r", None, "m"), ("r", None, "4\no"), ("r", "d", "z")], "repo_key string, path string, text string")
    got = [tuple(r) for r in tables.definitions(f).orderBy(F.col("path").asc_nulls_first(), "def_ord").select("path", "def_ord", "name", "line", "end_line").collect()]
    assert got == [(None, 1, "m", 1, 1), (None, 2, "o", 2, 2), ("a", 1, "x", 1, 1), ("a", 2, "y", 2, 2), ("a", 3, "k", 3, 3), ("d", 1, "z", 1, 1)]
