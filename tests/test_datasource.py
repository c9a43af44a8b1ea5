import json
import zipfile

import pytest

from codequarry.sources import datasource


@pytest.fixture
def archives(tmp_path):
    for name, n in (("one", 25), ("two", 7)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("src/", "")
            for i in range(n):
                z.writestr(f"src/f{i}.py" if i % 2 else f"docs/f{i}.md", f"text {name} {i}")
            z.writestr("__MACOSX/x", "no")
            z.writestr("bin", b"\xff\xfe\x00")
    return str(tmp_path)


def test_archives_are_split_into_partitions(spark, archives):
    datasource.register(spark)
    df = spark.read.format("zip_files").option("entriesPerPartition", 10).load(archives)
    assert df.rdd.getNumPartitions() == 4  # 26 and 8 entries
    rows = {(r["repo_key"], r["path"]): (r["size"], r["text"]) for r in df.collect()}
    assert len(rows) == 34 and rows["one", "bin"] == (3, None) and rows["two", "src/f1.py"] == (10, "text two 1")
    assert spark.read.format("zip_files").option("repoKey", "k").load(f"{archives}/t*.zip").select("repo_key").distinct().collect()[0][0] == "k"


def test_filters_reach_the_reader(spark, archives):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    datasource.register(spark)
    reader = datasource.ZipReader({"path": archives})
    size = GreaterThan(("size",), 3)
    assert list(reader.pushFilters([StringStartsWith(("path",), "src/"), EqualTo(("repo_key",), "two"), size])) == [size]
    assert [[p for _, p in part.names] for part in reader.partitions()] == [["src/f1.py", "src/f3.py", "src/f5.py"]]
    df = spark.read.format("zip_files").load(archives).filter("path LIKE 'src/%' AND repo_key = 'two' AND size > 3")
    assert sorted(r["path"] for r in df.collect()) == ["src/f1.py", "src/f3.py", "src/f5.py"]
    assert df.rdd.getNumPartitions() == 1
    assert spark.read.format("zip_files").load(archives).filter("path = 'nowhere'").count() == 0


def test_unsafe_and_broken_archives(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "up.zip", "w") as z:
        z.writestr("../x", "x")
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    for name, code in (("bad", "bad-zip"), ("up", "zip-insecure"), ("empty", "empty-zip"), ("gone", "not-found")):
        with pytest.raises(datasource.RepoError) as e:
            datasource.ZipReader({"path": f"{tmp_path}/{name}.zip"}).partitions()
        assert e.value.code == code


def test_recorded_trees(spark, tmp_path):
    def record(name, body, files):
        (tmp_path / name / "files").mkdir(parents=True)
        (tmp_path / name / "tree.json").write_text(json.dumps(body))
        for p, t in files.items():
            (tmp_path / name / "files" / p).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name / "files" / p).write_text(t)

    tree = [{"path": "src", "type": "tree"}, {"path": "src/a.py", "type": "blob"}, {"path": "b.md", "type": "blob"}, {"path": "sub", "type": "commit"}]
    record("r1", {"url": "https://api.github.com/x", "tree": tree}, {"src/a.py": "A", "b.md": "B"})
    record("r2", {"files": [{"name": "/src/c.py", "size": 1}, {"name": "/lost.py", "size": 1}]}, {"src/c.py": "C"})
    datasource.register(spark)
    read = spark.read.format("recorded_files")
    assert {tuple(r) for r in read.load(str(tmp_path)).collect()} == {("r1", "src/a.py", 1, "A"), ("r1", "b.md", 1, "B"), ("r2", "src/c.py", 1, "C")}
    assert {(r["path"], r["text"]) for r in spark.read.format("recorded_files").option("subDir", "src").load(str(tmp_path)).collect()} == {("a.py", "A"), ("c.py", "C")}
    for body, code in (({"status": 404}, "not-found"), ({"status": 403, "remaining": "0"}, "rate-limit"), ({"truncated": True}, "truncated"), ({"url": "http://elsewhere.example"}, "network")):
        record(f"bad-{code}", body, {})
        with pytest.raises(datasource.RepoError) as e:
            datasource.RecordedReader({"path": f"{tmp_path}/bad-{code}"}).partitions()
        assert e.value.code == code
