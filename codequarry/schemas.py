"""Fact tables and limits. Every table carries ``repo_key``, so many repositories share one table."""

from __future__ import annotations

from dataclasses import dataclass

FORMAT_VERSION = 1

SCHEMAS = {
    "files": "repo_key string, path string, size long, language string, text string, content_hash string",
    "tree": "repo_key string, path string, parent string, name string, depth int, type string, size long",
    "definitions": "repo_key string, path string, def_ord int, name string, kind string, line int, end_line int, signature string, exported boolean",
    "calls": "repo_key string, path string, call_ord long, from_name string, to_name string, line int",
    "refs": "repo_key string, path string, ref_ord long, name string, line int, col int, kind string",
    "imports": "repo_key string, path string, imp_ord int, spec string",
    "class_relations": "repo_key string, path string, rel_ord int, name string, extends array<string>, implements array<string>, line int",
    "file_metrics": "repo_key string, path string, language string, cyclomatic int, cognitive int, total_lines int, sloc int, comment_lines int, max_function_complexity int",
    "function_metrics": "repo_key string, path string, fn_ord int, name string, line int, end_line int, cyclomatic int, cognitive int, sloc int",
    "edges": "src string, dst string, weight double",
    "slices": "session string, address string, tokens int, file_tokens int, round int, hits int",
}


@dataclass(frozen=True)
class Limits:
    """Defaults of the limits; None lifts one. No default drops a file, a text or a match unseen."""

    files: int | None = 5000
    source_chars: int | None = None
    graph_nodes: int | None = 120
    search_files: int | None = 5000
    search_chars: int | None = None
    search_rows: int | None = 500
    line_chars: int = 300
    scan_entries: int | None = None
    scan_depth: int = 24
    read_bytes: int | None = None


LIMITS = Limits()
