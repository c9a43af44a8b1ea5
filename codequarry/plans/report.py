"""The HTML report (K5, K6): aggregates by Spark, the page from them."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cycles, graphs, metrics, modules
from ..storage import Tables
from .diagrams import call_diagram, module_diagram
from .pack import Repository


def report_model(repo: Repository, edges: DataFrame, nodes: DataFrame, calls: DataFrame) -> dict:
    """Everything that the page shows, each part bounded. ``edges``: file edges; ``nodes``, ``calls``: the function graph to draw."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    tables = Tables(repo.files.sparkSession, "report")  # what several parts read is made once
    edges, nodes, calls = (tables.write(t) for t in (edges, nodes, calls))
    model: dict = {"name": repo.name, "files": repo.files.count(), "symbols": repo.definitions.count()}
    if repo.function_metrics is not None and repo.file_metrics is not None:
        functions, measured = tables.write(repo.function_metrics), tables.write(repo.file_metrics)
        model["health"] = (rows(metrics.health(functions, measured)) or [None])[0]
        model["languages"] = rows(metrics.language_mix(measured).orderBy(F.desc("sloc"), "language").limit(20))
        model["top_files"] = rows(metrics.top_files(measured, 20).orderBy("rank"))
        model["top_functions"] = rows(metrics.top_functions(functions, 20).orderBy("rank"))
    model["reading"] = rows(graphs.reading_order(repo.files, edges).filter(F.col("order") <= 40).orderBy("order"))
    model["cycles"] = [r["cycle"] for r in cycles.find_cycles(edges).orderBy(F.size("cycle"), F.get("cycle", F.lit(0))).limit(20).collect()]
    m = tables.write(modules.modules(repo.files))
    model["layers"] = rows(modules.layers(m).orderBy(F.desc("files"), "purpose").limit(40))
    kept, kept_calls = (tables.write(t) for t in graphs.top_graph(nodes, calls))
    model["graph"] = {"nodes": kept.count(), "edges": kept_calls.count(), "total": nodes.count()}
    model["call_diagram"] = (rows(call_diagram(kept, kept_calls)) or [{"text": ""}])[0]["text"]
    top = tables.write(m.orderBy(F.desc("files"), "module").limit(40))
    between = modules.module_edges(edges).join(top.select("repo_key", F.col("module").alias("src")), ["repo_key", "src"], "left_semi").join(top.select("repo_key", F.col("module").alias("dst")), ["repo_key", "dst"], "left_semi")
    model["module_diagram"] = (rows(module_diagram(top, between)) or [{"text": ""}])[0]["text"]
    return model


def _table(rows: list[dict], *columns: str) -> str:
    if not rows:
        return "<p>none</p>"
    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(r.get(c, '')))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def render_html(model: dict) -> str:
    """One page without scripts, styles or links from elsewhere; all values are escaped."""
    sections = [f"<h1>{escape(model['name'])}</h1><p>{model['files']} files, {model['symbols']} symbols</p>"]
    if model.get("health"):
        sections.append("<h2>Health</h2>" + _table([model["health"]], "score", "functions", "avg_cyclomatic", "avg_cognitive", "high_complexity", "sloc"))
        sections.append("<h2>Languages</h2>" + _table(model["languages"], "language", "files", "sloc"))
        sections.append("<h2>Files</h2>" + _table(model["top_files"], "path", "max_function_complexity", "cyclomatic", "sloc"))
        sections.append("<h2>Functions</h2>" + _table(model["top_functions"], "path", "name", "cyclomatic", "cognitive"))
    sections.append("<h2>Reading order</h2>" + _table(model["reading"], "order", "path", "role", "in_degree", "out_degree"))
    sections.append("<h2>Cycles</h2>" + ("<ul>" + "".join(f"<li>{escape(' → '.join(c))}</li>" for c in model["cycles"]) + "</ul>" if model["cycles"] else "<p>none</p>"))
    sections.append("<h2>Layers</h2>" + _table([{**r, "dirs": ", ".join(r["dirs"])} for r in model["layers"]], "purpose", "files", "dirs"))
    for title, key in (("Calls", "call_diagram"), ("Modules", "module_diagram")):
        sections.append(f"<h2>{title}</h2><pre>{escape(model[key])}</pre>")
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px;text-align:left}"
    return f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{escape(model["name"])}</title><style>{style}</style></head>\n<body>\n' + "\n".join(sections) + "\n</body></html>\n"
