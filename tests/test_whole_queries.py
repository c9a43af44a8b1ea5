"""Queries that ask for whole tables, on a small one."""

import __spark_entry__ as entry


def test_every_line_has_its_enclosing_symbol(spark, sf, tmp_path):
    d = str(tmp_path)
    spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(30).coalesce(1).write.parquet(f"{d}/documents.parquet")
    run = lambda name: entry.queries()[name](spark, d).collect()
    files = {f"src/{r['source']}/{r['lang']}_{r['doc_id']}.md": r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    lines = {(p, i + 1) for p, t in files.items() for i in range(len(t.split("\n")))}
    every = {(r["path"], r["at"]): (r["name"], r["start"], r["end"]) for r in run("enclosing_symbol_lines")}
    assert set(every) == lines
    assert all(every[r["path"], r["at"]] == (r["name"], r["start"], r["end"]) for r in run("enclosing_symbol"))
