from pyspark.sql import functions as F

from codequarry.extract import driver
from codequarry.functions import sql, text
from codequarry.functions.paths import language

TEXTS = ["", "abc", "fooBar baz_qux", "日本語 text", "a.b-c/d e", "👩 ü\r\n\t", "x" * 300, None, "Some longer Text with Words", "src/main/fooBar.ts"]


def test_scalars_equal_the_expressions_and_stay_native(spark):
    sql.register(spark)
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").createOrReplaceTempView("texts")
    t = spark.table("texts")
    got = spark.sql("SELECT i, estimate_tokens(t) AS a, fits_budget(t, 100) AS b, content_hash(t) AS c, short_id(t) AS d FROM texts")
    want = t.select("i", text.estimate_tokens(F.col("t")).alias("a"), text.fits_budget(F.col("t"), 100).alias("b"), text.fnv1a(F.col("t")).alias("c"), text.short_id(F.col("t")).alias("d"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    for q in ("", "fb", "sfbts", "abc", "sw", "zz"):
        got = spark.sql(f"SELECT i, fuzzy_score('{q}', t) AS s FROM texts")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, t.select("i", text.fuzzy_score(F.lit(q), F.col("t"))).collect()), key=repr), q
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_facts_in_a_lateral_join(spark):
    sql.register(spark)
    files = {
        "a.py": "import os\nfrom b import c\nclass A(B):\n    def f(self):\n        if c():\n            return os.x()\n",
        "b.ts": "import { x } from './x';\nexport class T extends U implements V {\n  run() { if (a && b) { x(); } }\n}\n",
        "c.md": "# no code",
        "d.py": None,
    }
    df = spark.createDataFrame([("r", p, t) for p, t in files.items()], "repo_key string, path string, text string").withColumn("language", language(F.col("path"))).withColumn("content_hash", F.lit("h"))
    df.createOrReplaceTempView("files")
    x = spark.sql("SELECT f.path, x.* FROM files f, LATERAL extract_facts(f.path, f.language, f.text) x").cache()
    assert {r["fact"] for r in x.collect()} == {"definition", "call", "reference", "import", "relation", "function"}
    nested = driver.extract_files(df)
    rows = lambda d, *c: sorted(map(tuple, d.select(*c).collect()), key=repr)
    is_ = lambda fact: x.filter(F.col("fact") == fact)
    assert rows(is_("definition"), "path", "ord", "name", "kind", "line", "end_line", "exported") == rows(driver.definitions(nested), "path", "def_ord", "name", "kind", "line", "end_line", "exported")
    assert rows(is_("call"), "path", "ord", "other", "name", "line") == rows(driver.calls(nested), "path", "call_ord", "from_name", "to_name", "line")
    assert rows(is_("reference"), "path", "ord", "name", "line", F.col("other").cast("int")) == rows(driver.references(nested), "path", "ref_ord", "name", "line", "col")
    assert rows(is_("import"), "path", "ord", "name") == rows(driver.imports(nested), "path", "imp_ord", "spec")
    assert rows(is_("relation"), "path", "name", "other") == rows(driver.class_relations(nested), "path", "name", F.concat(F.array_join("extends", ","), F.lit("|"), F.array_join("implements", ",")))
    assert rows(is_("function"), "path", "name", "line", "end_line", "cyclomatic", "cognitive", "sloc") == rows(driver.function_metrics(nested), "path", "name", "line", "end_line", "cyclomatic", "cognitive", "sloc")
    cut = spark.sql("SELECT s.* FROM files f, LATERAL slice_text(f.text, f.path, 2, 3, NULL, 800) s WHERE f.path = 'a.py'").collect()
    assert [(r["start_line"], r["end_line"], r["truncated"], r["total_lines"]) for r in cut] == [(2, 3, False, 7)]
    x.unpersist()
