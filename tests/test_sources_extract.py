import io
import zipfile

import pytest
from pyspark.sql import functions as F

from codequarry.cache import FactCache, counters, split_by_cache
from codequarry.extract import driver
from codequarry.extract.driver import facts_of
from codequarry.functions import text
from codequarry.functions.tokens import fnv1a
from codequarry.sources import repos, tree
from codequarry.streaming import incremental, markers

SAMPLES = {
    "python": ("import os\nfrom .a import b\nclass A(Base):\n    def m(self):\n        return foo(1)\n\ndef _p():\n    pass\n", [("A", "class", 3, 5, True), ("m", "method", 4, 5, False), ("_p", "function", 7, 8, False)], [("m", "foo")], ["os", ".a"], [("A", ["Base"], [])]),
    "javascript": ("import x from './y';\nconst z = require('q');\nexport function foo(a) { return bar(a); }\nexport const arrow = (x) => baz(x);\nclass K extends B { m() { return this.n(); } }\n", [("foo", "function", 3, 3, True), ("arrow", "function", 4, 4, True), ("K", "class", 5, 5, False), ("m", "method", 5, 5, False)], [(None, "require"), ("foo", "bar"), (None, "baz"), ("m", "n")], ["./y", "q"], [("K", ["B"], [])]),
    "typescript": ("import {a} from '../m';\nexport interface I { x: number }\nexport enum E { A }\nexport class C extends D implements I, J {\n  private m(): void { foo(); }\n}\n", [("I", "interface", 2, 2, True), ("E", "enum", 3, 3, True), ("C", "class", 4, 6, True), ("m", "method", 5, 5, False)], [("m", "foo")], ["../m"], [("C", ["D"], ["I", "J"])]),
    "go": ('package m\nimport "fmt"\nimport (\n\t"os"\n)\ntype S struct {\n}\nfunc (s *S) Run() { help() }\nfunc help() int { return 0 }\n', [("S", "class", 6, 7, True), ("Run", "method", 8, 8, True), ("help", "function", 9, 9, False)], [("Run", "help")], ["fmt", "os"], []),
    "rust": ("use crate::a::b;\npub struct P { x: i32 }\nimpl P { pub fn new() -> P { build() } }\nfn build() {}\n", [("P", "class", 2, 2, True), ("new", "method", 3, 3, True), ("build", "function", 4, 4, False)], [("new", "build")], ["crate::a::b"], []),
    "java": ("import java.util.List;\npublic class A extends B implements C, D {\n  public void m(int x) { foo(); new Thing(); }\n  private int n() { return 1; }\n}\n", [("A", "class", 2, 5, True), ("m", "method", 3, 3, True), ("n", "method", 4, 4, False)], [("m", "foo"), ("m", "Thing")], ["java.util.List"], [("A", ["B"], ["C", "D"])]),
    "c": ('#include "a.h"\nstruct s { int x; };\nstatic int f(int a) { return g(a); }\nint main(void) { return f(1); }\n', [("s", "class", 2, 2, True), ("f", "function", 3, 3, False), ("main", "function", 4, 4, True)], [("f", "g"), ("main", "f")], ["a.h"], []),
    "cpp": ("#include <v>\nclass A : public B {\n  int p() { return 1; }\npublic:\n  int m() { return n(); }\n};\nint A::k() { return 2; }\n", [("A", "class", 2, 6, True), ("p", "method", 3, 3, False), ("m", "method", 5, 5, True), ("k", "method", 7, 7, True)], [("m", "n")], ["v"], [("A", ["B"], [])]),
    "csharp": ("using System.Text;\npublic class A : B {\n  public int M(int x) { Foo(); return 1; }\n}\n", [("A", "class", 2, 4, True), ("M", "method", 3, 3, True)], [("M", "Foo")], ["System.Text"], [("A", ["B"], [])]),
    "php": ("<?php\nuse App\\User;\nclass A extends B implements C {\n  private function m() { return foo(); }\n}\n", [("A", "class", 3, 5, True), ("m", "method", 4, 4, False)], [("m", "foo")], ["App\\User"], [("A", ["B"], ["C"])]),
    "kotlin": ("import a.b.C\nclass A : B(), I {\n  fun m() { foo() }\n}\nprivate fun q() { }\n", [("A", "class", 2, 4, True), ("m", "method", 3, 3, True), ("q", "function", 5, 5, False)], [(None, "B"), ("m", "foo")], ["a.b.C"], [("A", ["B"], ["I"])]),
    "swift": ("import Foundation\nclass A: B, P {\n  func m() { foo() }\n  private func q() {}\n}\n", [("A", "class", 2, 5, True), ("m", "method", 3, 3, True), ("q", "method", 4, 4, False)], [("m", "foo")], ["Foundation"], [("A", ["B"], ["P"])]),
    "ruby": ("require 'set'\nclass A < B\n  def m(x)\n    if x\n      foo(x)\n    end\n  end\n  private\n  def q\n  end\nend\n", [("A", "class", 2, 11, True), ("m", "method", 3, 7, True), ("q", "method", 9, 10, False)], [("m", "foo")], ["set"], [("A", ["B"], [])]),
}


@pytest.mark.parametrize("language", SAMPLES)
def test_languages(language):
    text, definitions, calls, imports, relations = SAMPLES[language]
    f = facts_of(text, language)
    assert [(d[0], d[1], d[2], d[3], d[5]) for d in f.definitions] == definitions
    assert [c[:2] for c in f.calls] == calls and f.imports == imports and [r[:3] for r in f.relations] == relations and not f.has_error


@pytest.mark.parametrize(
    ("body", "cyclomatic", "cognitive"),
    [
        ("if (a) {} if (b) {} if (c) {}", 4, 3),
        ("if (a) { while (b) { if (c) { } } }", 4, 6),
        ("for (;;) { if (a) { break; } if (b) { continue; } }", 4, 7),
        ("return a && b || c;", 3, 2),
    ],
)
def test_complexity(body, cyclomatic, cognitive):
    f = facts_of(f"function f() {{ {body} }}\n", "javascript").functions[0]
    assert (f[3], f[4]) == (cyclomatic, cognitive)


def test_module_level_decision():
    assert facts_of("if (x) { y(); }\n", "javascript").top_decisions == 1
    assert facts_of("if x:\n    y()\n", "python").top_decisions == 1


def test_broken_source():
    f = facts_of("def ok():\n    return 1\n\ndef bad(:\n", "python")
    assert f.has_error and [d[0] for d in f.definitions] == ["ok", "bad"]
    assert facts_of("function f() { if (", "javascript").has_error


def test_comments_and_strings_hide_code():
    f = facts_of('// foo()\nconst s = "bar()";\n/* baz()\n */ real();\n', "javascript")
    assert [c[1] for c in f.calls] == ["real"] and f.comment_lines == {1, 3, 4}


@pytest.fixture
def repo(tmp_path):
    for name, text in {"src/a.ts": SAMPLES["typescript"][0], "src/b.py": SAMPLES["python"][0], "README.md": "# x", "node_modules/x.js": "bad()", "img.png": "x", "sub dir/ü+1.go": SAMPLES["go"][0]}.items():
        p = tmp_path / "repo" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "repo" / "bin.txt").write_bytes(b"\xff\xfe\x00")
    return tmp_path


def test_local_source(spark, repo):
    got = {r["path"]: r for r in repos.read_repo(spark, "local", str(repo / "repo"), "r").collect()}
    assert set(got) == {"src/a.ts", "src/b.py", "README.md", "sub dir/ü+1.go"}
    assert got["src/a.ts"]["language"] == "typescript" and got["README.md"]["language"] is None and got["src/b.py"]["content_hash"] == fnv1a(SAMPLES["python"][0])
    assert [p for p, _ in repos.scan_local(str(repo / "repo"))] == ["README.md", "bin.txt", "img.png", "src/a.ts", "src/b.py", "sub dir/ü+1.go"]
    assert repos.read_bytes(spark, str(repo / "repo")).count() == 7
    with pytest.raises(repos.RepoError) as e:
        repos.read_local(spark, str(repo / "nowhere"), "r")
    assert e.value.code == "not-found-dir"


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_zip_source(spark, tmp_path):
    (tmp_path / "my.zip").write_bytes(archive([("a/b.py", "def f(): pass"), ("__MACOSX/x", "x"), ("a/._b", "x"), ("bin", b"\xff\xfe")]))
    got = {r["path"]: (r["repo_key"], r["text"]) for r in repos.read_zip(spark, str(tmp_path / "my.zip")).collect()}
    assert got == {"a/b.py": ("my", "def f(): pass"), "bin": ("my", None)}
    for data, code in ((b"junk", "bad-zip"), (archive([]), "empty-zip"), (archive([("../x", "y")]), "zip-insecure")):
        with pytest.raises(repos.RepoError) as e:
            repos.zip_entries(data)
        assert e.value.code == code


def test_remote_sources(spark):
    body = '{"truncated": false, "tree": [{"path": "src/a.ts", "type": "blob", "size": 3}, {"path": "src", "type": "tree"}, {"path": "m", "type": "commit"}, {"path": "x.py", "type": "blob", "size": 9}]}'
    listing = spark.createDataFrame([("o/r", body)], "repo_key string, body string")
    assert {(r["path"], r["type"]) for r in repos.remote_tree(listing).collect()} == {("src/a.ts", "file"), ("src", "dir"), ("x.py", "file")}
    assert [r["path"] for r in repos.remote_tree(listing, "src").collect()] == ["a.ts"]
    with pytest.raises(Exception, match="truncated"):
        repos.remote_tree(spark.createDataFrame([("r", body.replace("false", "true"))], listing.schema)).collect()
    flat = spark.createDataFrame([("r", '{"files": [{"name": "/src/a.ts", "size": 1}]}')], listing.schema)
    assert [r["path"] for r in repos.manifest_tree(flat, "/src/").collect()] == ["a.ts"]
    contents = spark.createDataFrame([("o/r", "x.py", "x")], "repo_key string, path string, text string")
    other = spark.createDataFrame([("o/r", "src/a.ts", "y")], contents.schema)
    assert {r["path"]: r["text"] for r in repos.remote_files(repos.remote_tree(listing), contents, other).collect()} == {"x.py": "x", "src/a.ts": "y"}
    found = spark.createDataFrame([("q", '{"items": [{"full_name": "a/b", "stargazers_count": 5}, {"full_name": "c/d", "stargazers_count": 9, "description": "z"}]}')], "query string, body string")
    assert [r["full_name"] for r in repos.search_repos(found).collect()] == ["c/d", "a/b"]
    assert repos.error_code(403, "0") == "rate-limit" and repos.error_code(404) == "not-found" and repos.error_code(401) == "private" and repos.error_code(200) is None
    with pytest.raises(repos.RepoError):
        repos.check_url("https://example.com/x")


def test_input_router(spark):
    asked = ["https://github.com/o/r", "github.com/o/r.git", "https://github.com/o/r/tree/main/src/x/", "git@github.com:o/r.git", "o/r", "react hooks", "https://github.com/o", "  "]
    got = {r["input"]: (r["kind"], r["owner"], r["repo"], r["branch"], r["sub_dir"]) for r in repos.route_input(spark.createDataFrame([(a,) for a in asked], "input string")).collect()}
    assert got[asked[0]] == got[asked[1]] == got[asked[3]] == ("url", "o", "r", None, None)
    assert got[asked[2]] == ("url", "o", "r", "main", "src/x") and got["o/r"][:3] == ("owner-repo", "o", "r") and got["react hooks"][0] == "search" and got[asked[6]][0] == "invalid" and len(got) == 7


def test_tree(spark):
    entries = [("r", "./src\\a.ts", "file", 1), ("r", "src/a.ts", "file", 1), ("r", "/b.md", "file", 2), ("r", "empty/", "dir", None), ("r", "src/z/y.ts", "file", 3)]
    t = tree.build_tree(spark.createDataFrame(entries, "repo_key string, path string, type string, size long"))
    assert [r["path"] for r in tree.display_order(t).collect()] == ["empty", "src", "src/z", "src/z/y.ts", "src/a.ts", "b.md"]
    again = tree.build_tree(t.select("repo_key", "path", "type", "size"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, t.collect()))
    assert tree.file_count(t).first()["files"] == 3 and tree.flatten(t, "dir").count() == 3


def test_manifest_and_friends(spark):
    body = '{"name": "p", "version": "1", "scripts": {"b": "x", "a": "y"}, "dependencies": {"z": "1", "y": "2"}}'
    rows = [("r", "package.json", body), ("r", "yarn.lock", ""), ("r", "package-lock.json", ""), ("r", "docs/README.md", ""), ("r", "readme.md", ""), ("r", "src/index.ts", ""), ("r", "main.py", ""), ("bad", "package.json", "{"), ("list", "package.json", "[]")]
    f = spark.createDataFrame(rows, "repo_key string, path string, text string")
    m = tree.manifests(f).collect()
    assert len(m) == 1 and m[0]["name"] == "p" and [s["name"] for s in m[0]["scripts"]] == ["b", "a"] and m[0]["dependencies"] == ["z", "y"]
    assert [(r["repo_key"], r["manager"]) for r in tree.package_manager(f).collect()] == [("r", "yarn")]
    assert [r["path"] for r in tree.pick_readme(f).collect()] == ["readme.md"]
    assert [r["path"] for r in tree.entry_files(f).orderBy("rank").collect()] == ["main.py", "src/index.ts"]


def source_files(spark, texts):
    return spark.createDataFrame([("r", p, t, lang, fnv1a(t)) for p, t, lang in texts], "repo_key string, path string, text string, language string, content_hash string")


def test_extraction_tables(spark):
    f = source_files(spark, [(f"a.{lang}", SAMPLES[lang][0], lang) for lang in SAMPLES] + [("x.txt", "plain", None)])
    nested = driver.extract_files(f).cache()
    assert nested.count() == len(SAMPLES)
    assert driver.definitions(nested).count() == sum(len(s[1]) for s in SAMPLES.values())
    assert driver.imports(nested).count() == sum(len(s[3]) for s in SAMPLES.values()) and driver.class_relations(nested).count() == sum(len(s[4]) for s in SAMPLES.values())
    assert driver.calls(nested).count() == sum(len(s[2]) for s in SAMPLES.values()) and driver.references(nested).count() > 10
    m = {r["path"]: r for r in driver.file_metrics(nested).collect()}
    assert m["a.ruby"]["cyclomatic"] == 3 and m["a.python"]["total_lines"] == 9 and driver.function_metrics(nested).count() > 10


def test_cache_and_stream(spark, tmp_path):
    cache = FactCache(spark, str(tmp_path / "facts"), driver.NESTED)
    v1 = source_files(spark, [("a.py", "def f(): pass\n", "python"), ("b.py", "def g(): pass\n", "python")])
    v2 = source_files(spark, [("a.py", "def f(): pass\n", "python"), ("b.py", "def changed(): pass\n", "python"), ("c.py", "x = 1\n", "python")])
    assert cache.count() == 0
    assert incremental.update_facts(v1, cache).count() == 2 and cache.count() == 2
    assert counters(split_by_cache(v2, cache.read())).first().asDict() == {"repo_key": "r", "files": 3, "cached": 1, "parsed": 2, "failed": 0}
    assert {d["name"] for r in incremental.update_facts(v2, cache).collect() for d in r["definitions"]} == {"f", "changed"} and cache.count() == 4
    v2.write.parquet(str(tmp_path / "in" / "1"))
    streamed = FactCache(spark, str(tmp_path / "streamed"), driver.NESTED)
    for _ in range(2):  # a replay adds nothing
        stream = spark.readStream.schema(v2.schema).parquet(str(tmp_path / "in" / "*"))
        incremental.stream_facts(stream, streamed, str(tmp_path / f"check{_}")).awaitTermination()
    assert sorted(r["path"] for r in streamed.read().collect()) == ["a.py", "b.py", "c.py"]
    streamed.clear("r")
    assert streamed.count() == 0


TRANSCRIPT = ["Hello\n@@exp", "and src/a.ts:3\nmore", " text @@expand no\n@", "@expand b.ts\n", "@@expand two words\n \u00a0```@@expand  c.ts`` \r\n@@expand\nend\n@@ex"]


def test_markers(spark, tmp_path):
    whole = "".join(TRANSCRIPT)
    for cut in range(1, 9):
        f = markers.MarkerFilter()
        out = "".join(f.feed(whole[i : i + cut]) for i in range(0, len(whole), cut)) + f.finish()
        assert out == "Hello\nmore text @@expand no\n@@expand two words\n@@expand\nend\n@@ex" and f.addresses == ["src/a.ts:3", "b.ts", "c.ts"]
    chunks = spark.createDataFrame([("s", i, c) for i, c in enumerate(TRANSCRIPT)], "session string, seq long, chunk string")
    r = markers.filter_transcripts(chunks).first()
    assert r["addresses"] == ["src/a.ts:3", "b.ts", "c.ts"]
    whole_text = spark.createDataFrame([(whole,)], "text string")
    assert whole_text.select(text.marker_addresses(F.col("text"))).first()[0] == ["src/a.ts:3", "b.ts", "c.ts"]
    for i, c in enumerate(TRANSCRIPT):
        chunks.filter(F.col("seq") == i).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = markers.filter_markers(stream).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("kept").collect()
    assert sorted(a for x in rows for a in x["addresses"]) == ["b.ts", "c.ts", "src/a.ts:3"]


def test_deltas(spark):
    body = 'data: {"choices":[{"delta":{"content":"He"}}]}\n\nnot json\ndata: {"choices":[{"delta":{"content":"llo"}}]}\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"no"}}]}\n'
    for cut in (3, 10, 1000):
        p = markers.DeltaParser()
        assert "".join(p.feed(body[i : i + cut]) for i in range(0, len(body), cut)) + p.finish() == "Hello"
    chunks = spark.createDataFrame([("s", i, body[i * 20 : i * 20 + 20]) for i in range(20)], "session string, seq long, chunk string")
    assert markers.parse_deltas(chunks).first()["text"] == "Hello"


def test_cancellable(spark):
    with incremental.cancellable(spark, 60) as tag:
        assert tag in spark.getTags() and spark.range(10).count() == 10
    assert tag not in spark.getTags()


def test_event_windows(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert incremental.event_windows(e).agg(F.sum("n")).first()[0] == e.count()
    assert incremental.event_sessions(e).agg(F.sum("n")).first()[0] == e.count()
