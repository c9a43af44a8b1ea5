import random

import numpy as np
import pytest

from codequarry.operators import file_calls, graphs
from codequarry.sources import tables

WORDS = "Alpha beta gamma Delta epsilon zeta kappa lambda omega sigma".split()


def documents(spark, n=40):
    rng = random.Random(7)
    line = lambda k: rng.choice(["", "  ", "12 "]) + " ".join(rng.choice([*WORDS, f"own{k}", "Kelvin", "ab"]) for _ in range(rng.randrange(6)))
    rows = [(k, "s", "en", "\n".join(line(chr(97 + k % 26) * (4 + k // 26)) for _ in range(rng.randrange(1, 12)))) for k in range(n)]
    return tables.files(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"))


def wanted(defs, calls, imported):
    """The rule, call by call."""
    last, first = {}, {}
    for r in sorted(defs, key=lambda r: r["def_ord"]):
        last[r["path"], r["name"]] = r["line"]
        first[r["path"], r["name"]] = min(r["line"], first.get((r["path"], r["name"]), r["line"]))
    owners = {}
    for path, name in first:
        owners.setdefault(name, []).append(path)
    out = set()
    for path, caller, name in {(r["path"], r["from_name"], r["to_name"]) for r in calls}:
        if (path, caller) not in last:
            continue
        own = owners.get(name, [])
        via = [o for o in own if (path, o) in imported]
        if (path, name) in last:
            to = (path, last[path, name])
        elif len(own) == 1 or len(via) == 1:
            to = (o := (own if len(own) == 1 else via)[0], first[o, name])
        else:
            continue
        src, dst = f"{path}#{caller}@{last[path, caller]}", f"{to[0]}#{name}@{to[1]}"
        out |= {(src, dst)} if src != dst else set()
    return out


@pytest.mark.parametrize("chunk", [1, 50, 1 << 20])
def test_edges_by_file_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(file_calls, "CHUNK", chunk)
    f = documents(spark)
    d, c = tables.definitions(f), tables.calls(f)
    paths = sorted(r["path"] for r in f.collect())
    links = {(a, paths[(k * 7 + j) % len(paths)]) for k, a in enumerate(paths) for j in (1, 3)}
    imported = spark.createDataFrame([("documents", *x) for x in links], "repo_key string, src string, dst string")
    by_rule = wanted(d.collect(), c.collect(), links)
    assert len(by_rule) > 100
    for nested in (None, lambda met: tables.nested(f, met)):
        edges = graphs.call_graph(d, c, imported, nested)[1].collect()
        assert len(edges) == len(by_rule) and {(r["src"], r["dst"]) for r in edges} == by_rule


def test_files_of_one_path_are_one_row(spark):
    f = documents(spark, 3)
    assert tables.nested(f.union(f)).count() == 3


def test_calls_are_not_dealt_out(spark):
    """Once each call was a row dealt to its file: calls that nothing can answer leave no row now, before anything is shuffled."""
    f = documents(spark).limit(0).unionByName(tables.files(spark.createDataFrame([(k, "s", "en", "Same other\n" + "Same words again and other ones\n" * 50) for k in range(20)], "doc_id long, source string, lang string, text string")))
    d, none = tables.definitions(f), spark.createDataFrame([], "repo_key string, src string, dst string")
    nested = tables.nested(f).join(file_calls.near_names(d.withColumn("first", d["line"]), none), ["repo_key", "path"], "left")
    assert tables.calls(f).count() > 5000
    assert file_calls.answered(nested, file_calls.sieve(d.select("name").limit(0))).count() == 20


def test_sieve_lets_all_names_through(spark):
    bits = file_calls.sieve(spark.range(3000).selectExpr("concat('n', id) AS name"))
    assert bits.dtype == np.uint64 and sum(int(x).bit_count() for x in bits) > 2900 and len(bits) * 64 >= 16 * 3000
