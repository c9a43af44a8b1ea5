"""Packs of several repositories at once, against a search over whole renderings of each."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.functions.tokens import estimate
from codequarry.plans import pack, packs


def rendering(fixed, lines, n):
    out = fixed
    if n:
        out += "\n\n## Symbols\n\n" + "\n".join(x for _, x in lines[:n])
    if n < len(lines):
        out += f"\n\n_{n} of {len(lines)} symbols in {len({p for p, _ in lines[:n]})} files._"
    return out


def brute(layers, lines, budget):
    """Every layer with every number of lines."""
    fits = lambda t: estimate(t) <= 0.95 * budget
    for k, fixed in enumerate(layers):
        most = max((n for n in range(len(lines) + 1) if fits(rendering(fixed, lines, n))), default=None)
        if most is not None and most >= min(packs.WANTED, len(lines)):
            break
    if most is None:
        return k, 0, 0, pack.shrink(rendering(layers[-1], lines, 0), budget)
    return k, most, len({p for p, _ in lines[:most]}), rendering(layers[k], lines, most)


@pytest.mark.parametrize("budget", [60, 300, 1500])
def test_layers_fit_as_renderings_do(spark, budget):
    rng = random.Random(budget)
    word = lambda: "".join(rng.choice("abc_9 .,:é中文") for _ in range(rng.randint(1, 12)))
    repos = {}
    for r in range(14):
        n = rng.choice([0, 1, 4, 5, 40, 200])
        layers = [f"# r{r}\n\n" + word() * rng.randint(0, size) for size in (60, 20, 2)]
        repos[f"r{r}"] = (layers, [(f"p{rng.randint(0, 5)}", f"- {word()}{word()}") for _ in range(n)])
    repos["long"] = (["# a\n\n## b\n" + "x " * 5000, "# a\n\n## c\n" + "y " * 4000], [("p", "- z")])
    lines = spark.createDataFrame([(r, k + 1, p, t) for r, (_, ls) in repos.items() for k, (p, t) in enumerate(ls)] + [("no layers", 1, "p", "- q"), (None, 1, "p", "- q")], "repo_key string, rank long, path string, line string")
    layers = spark.createDataFrame([(r, k, t) for r, (ts, _) in repos.items() for k, t in enumerate(ts)], "repo_key string, layer int, fixed string")
    got = {r["repo_key"]: r for r in packs.fit_layers(lines, layers, budget).collect()}
    assert set(got) == set(repos)
    for name, (texts, ls) in repos.items():
        k, n, cover, text = brute(texts, ls, budget)
        g = got[name]
        assert (g["layer"], g["included"], g["files"], g["markdown"]) == (k, n, cover, text), name
        assert g["total"] == len(ls) and g["tokens"] == estimate(text)
        assert g["min_tokens"] == estimate(rendering(texts[-1], ls, 0))


def test_no_rows(spark):
    lines = spark.createDataFrame([], "repo_key string, rank long, path string, line string")
    layers = spark.createDataFrame([], "repo_key string, layer int, fixed string")
    assert packs.fit_layers(lines, layers, 100).collect() == []


@pytest.fixture(scope="module")
def facts(spark):
    files, defs, calls, imports = [], [], [], []
    for r, size in (("one", 3), ("two", 12), ("bare", 0)):
        files += [(r, "package.json", '{"name": "%s", "version": "2", "scripts": {"build": "make"}, "dependencies": {"left": "1"}}' % r, None), (r, "yarn.lock", "", None)]
        for k in range(size):
            path = f"src/m{k % 3}/f{k}.js"
            files.append((r, path, "", "javascript"))
            for j in range(4):
                defs.append((r, path, j, f"{r}{k}_{j}", "function", 3 * j + 1, 3 * j + 2, f"function  {r}{k}_{j}\n(a)", j % 2 == 0))
            if k:
                calls.append((r, path, 1, f"{r}{k}_1", f"{r}{k - 1}_0", 5))
                imports.append((r, path, 0, f"../m{(k - 1) % 3}/f{k - 1}"))
    return (
        spark.createDataFrame(files, "repo_key string, path string, text string, language string"),
        spark.createDataFrame(defs, "repo_key string, path string, def_ord int, name string, kind string, line int, end_line int, signature string, exported boolean"),
        spark.createDataFrame(calls, "repo_key string, path string, call_ord int, from_name string, to_name string, line int"),
        spark.createDataFrame(imports, "repo_key string, path string, imp_ord int, spec string"),
    )


@pytest.mark.parametrize(("intent", "budget"), [("overview", 600), ("api", 400)])
def test_each_repository_has_its_pack(facts, intent, budget):
    # ranks are given in one of the cases
    given = facts[1].withColumn("score", F.lit(0.5)).withColumn("rank", F.row_number().over(Window.partitionBy("repo_key").orderBy("path", "line"))) if intent == "api" else None
    got = {r["repo_key"]: r for r in packs.repository_packs(*facts, intent=intent, budget=budget, ranked=given).collect()}
    assert set(got) == {"one", "two", "bare"}
    for name, size in (("one", 3), ("two", 12), ("bare", 0)):
        g = got[name]
        body = json.loads(g["json"])
        assert g["tokens"] == estimate(g["markdown"]) <= 0.95 * budget
        assert g["total"] == size * (4 if intent == "overview" else 2)
        assert len(body["symbols"]) == g["included"] and len(body["files"]) == size + 2 and body["intent"] == intent
        assert len(body["calls"]) == max(0, size - 1)
        assert g["markdown"].startswith(f"# {name}\n\n{size + 2} files, {size * 4} symbols. ")
        assert f"Package {name} 2\n- `build`: make\nUses left\nPackage manager: yarn" in g["markdown"]
        other = {"one": "two", "two": "one", "bare": "one"}[name]
        assert other not in g["markdown"]
    one = got["one"]
    if intent == "api":
        assert all(s["exported"] for s in json.loads(one["json"])["symbols"])
    else:
        assert one["included"] == 12 and "## Symbols" in one["markdown"]
        # the first symbol is of the file that most others lead to
        assert json.loads(one["json"])["symbols"][0]["file"] == "src/m0/f0.js"


def test_unknown_intent(facts):
    with pytest.raises(ValueError, match="nothing"):
        packs.repository_packs(*facts, intent="nothing")
