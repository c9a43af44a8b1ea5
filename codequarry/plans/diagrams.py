"""Diagram texts (K7-K11) from node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_html, escape_label, short_id

# Fixed value: the style of nodes that much depends on.
HOT_STYLE = "  classDef hot fill:#4a6cf7,stroke:#5d7bff,color:#ffffff;"


def _text(parts: DataFrame, head: str) -> DataFrame:
    """(repo_key, text): the lines of (repo_key, key, line) in order of ``key`` below a head. A diagram is as large as what was kept for it."""
    g = parts.groupBy("repo_key").agg(F.array_sort(F.collect_list(F.struct("key", "line"))).alias("l"))
    return g.select("repo_key", F.concat(F.lit(head), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


def _key(*columns: Column) -> Column:
    return F.array(*[c.cast("string") for c in columns])


def _hot(ids: DataFrame) -> DataFrame:
    names = ids.groupBy("repo_key").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    lines = F.array(F.lit(HOT_STYLE), F.concat(F.lit("  class "), "ids", F.lit(" hot;")))
    return names.select("repo_key", F.posexplode(lines).alias("k", "line")).select("repo_key", _key(F.lit("9"), F.col("k")).alias("key"), "line")


def call_diagram(nodes: DataFrame, edges: DataFrame, direction: str = "LR") -> DataFrame:
    """K7: functions by file; ``==>`` between files, ``-->`` within; those called by two or more stand out."""
    pad = lambda c: F.lpad(c.cast("string"), 12, "0")
    box = F.concat(F.lit("    "), short_id(F.col("id")), F.lit('["'), escape_label(F.concat("name", F.lit(" ("), F.col("line").cast("string"), F.lit(")"))), F.lit('"]'))
    opened = nodes.select("repo_key", "path").distinct().select("repo_key", _key(F.lit("1"), F.col("path"), F.lit("0")).alias("key"), F.concat(F.lit("  subgraph f_"), short_id(F.col("path")), F.lit('["'), escape_label(F.col("path")), F.lit('"]')).alias("line"))
    inner = nodes.select("repo_key", _key(F.lit("1"), F.col("path"), F.concat(F.lit("1"), pad(F.col("line")), "name")).alias("key"), box.alias("text")).withColumnRenamed("text", "line")
    closed = nodes.select("repo_key", "path").distinct().select("repo_key", _key(F.lit("1"), F.col("path"), F.lit("2")).alias("key"), F.lit("  end").alias("line"))
    file_of = lambda c: F.substring_index(c, "#", 1)
    arrow = F.when(file_of(F.col("src")) != file_of(F.col("dst")), " ==> ").otherwise(" --> ")
    arrows = edges.select("repo_key", _key(F.lit("2"), F.col("src"), F.col("dst")).alias("key"), F.concat(F.lit("  "), short_id(F.col("src")), arrow, short_id(F.col("dst"))).alias("line"))
    hot = _hot(nodes.filter("in_degree >= 2").select("repo_key", short_id(F.col("id")).alias("id")))
    return _text(opened.unionByName(inner).unionByName(closed).unionByName(arrows).unionByName(hot), f"graph {direction}")


def module_diagram(nodes: DataFrame, edges: DataFrame, direction: str = "LR") -> DataFrame:
    """K8: modules with their number of files, edges with their weight; those that two or more depend on stand out."""
    shown = F.when(F.col("module") == "(root)", ".").otherwise(F.col("module"))
    boxes = nodes.select("repo_key", _key(F.lit("1"), F.col("depth"), F.col("module")).alias("key"), F.concat(F.lit("  "), short_id(F.col("module")), F.lit('["'), escape_label(F.concat(shown, F.lit(" ("), F.col("files").cast("string"), F.lit(")"))), F.lit('"]')).alias("line"))
    arrows = edges.select("repo_key", _key(F.lit("2"), F.lpad((F.lit(10**12) - F.col("weight").cast("long")).cast("string"), 13, "0"), F.concat_ws("\0", "src", "dst")).alias("key"), F.concat(F.lit("  "), short_id(F.col("src")), F.lit(" -->|"), F.col("weight").cast("long").cast("string"), F.lit("| "), short_id(F.col("dst"))).alias("line"))
    hot = _hot(edges.groupBy("repo_key", "dst").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("repo_key", short_id(F.col("dst")).alias("id")))
    return _text(boxes.unionByName(arrows).unionByName(hot), f"graph {direction}")


def class_id(node_id: Column, name: Column) -> Column:
    """A readable name and five digits of the id's hash."""
    base = F.regexp_replace(name, r"[^A-Za-z0-9_$]", "_")
    return F.concat(F.when(base == "", "C").otherwise(base), F.lit("_"), F.substring(short_id(node_id), 2, 5))


def class_diagram(nodes: DataFrame, edges: DataFrame, direction: str = "LR") -> DataFrame:
    """K9."""
    n = nodes.select("repo_key", "id", class_id(F.col("id"), F.col("name")).alias("c"), "name")
    boxes = n.select("repo_key", _key(F.lit("1"), F.col("name"), F.col("id")).alias("key"), F.concat(F.lit("  class "), "c").alias("line"))
    e = edges.join(n.select("repo_key", F.col("id").alias("src"), F.col("c").alias("child")), ["repo_key", "src"]).join(n.select("repo_key", F.col("id").alias("dst"), F.col("c").alias("parent")), ["repo_key", "dst"])
    arrows = e.select("repo_key", _key(F.lit("2"), F.col("src"), F.concat_ws("\0", "dst", "kind")).alias("key"), F.concat(F.lit("  "), "parent", F.when(F.col("kind") == "extends", " <|-- ").otherwise(" <|.. "), "child").alias("line"))
    return _text(boxes.unionByName(arrows), f"classDiagram\n  direction {direction}")


def standalone_page(diagrams: DataFrame, title: str) -> DataFrame:
    """(repo_key, html): the diagram's source in a page of its own, without scripts."""
    page = F.concat(F.lit(f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{title}</title></head>\n<body><pre class="diagram">\n'), escape_html(F.col("text")), F.lit("\n</pre></body></html>"))
    return diagrams.select("repo_key", page.alias("html"))
