"""Calls, which are the most rows, are dealt out by their names once."""

import re

import pytest

from codequarry.operators import resolve, symbols


@pytest.fixture
def merged(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def deals(df):
    return len(re.findall(r"Exchange \w", df._jdf.queryExecution().executedPlan().toString()))


def facts(spark):
    defs = [("a", 1, "f", 3), ("a", 2, "f", 9), ("b", 1, "f", 1), ("b", 2, "g", 2), (None, 1, "h", 1), ("c", 1, "f", 5), ("b", 3, "n", 4), (None, 2, "n", 7)]
    asked = [("a", "f"), ("a", "f"), ("a", "g"), ("d", "f"), (None, "g"), (None, "h"), ("c", "nothing"), ("b", None), ("c", "n")]
    d = spark.createDataFrame([("r", *x) for x in defs], "repo_key string, path string, def_ord int, name string, line int")
    return d.selectExpr("substring(repo_key, 1) AS repo_key", "path", "def_ord", "name", "line"), asked


def test_local_first(spark, merged):
    d, asked = facts(spark)
    c = spark.createDataFrame([(*x,) for x in asked], "path string, to_name string").selectExpr("'r' AS repo_key", "path", "to_name")
    df = resolve.local_first(c, d)
    assert deals(df) <= 3
    got = {(r["path"], r["to_name"]): (r["target"], r["how"]) for r in df.collect()}
    assert df.count() == len(got) == len(set(asked))
    assert got == {
        ("a", "f"): ("a", "local"), ("a", "g"): ("b", "unique"), ("d", "f"): (None, "none"), (None, "g"): ("b", "unique"), (None, "h"): (None, "none"), ("c", "nothing"): (None, "none"),
        ("b", None): (None, "none"), ("c", "n"): ("b", "unique"),
    }


def test_goto_definition(spark, merged):
    d, asked = facts(spark)
    d = d.unionByName(spark.createDataFrame([("r", "a", 3, "z", 2), ("r", "a", 1, "z", 2_000_000_000), ("r", "b", 9, "z", 1)], d.schema))
    r = spark.createDataFrame([(*x,) for x in [*asked, ("a", "z"), ("q", "z")]], "current_path string, name string").selectExpr("'r' AS repo_key", "name", "current_path").distinct()
    df = symbols.goto_definition(r, d)
    assert deals(df) <= 4
    got = {(x["current_path"], x["name"]): (x["path"], x["line"]) for x in df.collect()}
    assert df.count() == len(got)
    assert got == {
        ("a", "f"): ("a", 3), ("a", "g"): ("b", 2), ("d", "f"): ("a", 3), (None, "g"): ("b", 2), (None, "h"): (None, 1), ("c", "n"): (None, 7),
        ("a", "z"): ("a", 2_000_000_000), ("q", "z"): ("a", 2),
    }
