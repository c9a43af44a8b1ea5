"""The extraction pass: ``files`` in, one nested row of facts per file out, and the fact tables from it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import LIMITS
from . import lexer, python_ast
from .lexer import Facts
from .spec import SPECS

_DEF = "array<struct<name:string,kind:string,line:int,end_line:int,signature:string,exported:boolean>>"
NESTED = (
    f"repo_key string, path string, language string, content_hash string, definitions {_DEF}, calls array<struct<from_name:string,to_name:string,line:int>>, "
    "refs array<struct<name:string,line:int,col:int,kind:string>>, imports array<string>, relations array<struct<name:string,extends:array<string>,implements:array<string>,line:int>>, "
    "functions array<struct<name:string,line:int,end_line:int,cyclomatic:int,cognitive:int,sloc:int>>, total_lines int, sloc int, comment_lines int, top_decisions int, has_error boolean"
)
#: Extractors by language; more can be registered before a run.
EXTRACTORS: dict[str, Callable[[str], Facts]] = {}


def register(language: str, extractor: Callable[[str], Facts]) -> None:
    EXTRACTORS[language] = extractor


def facts_of(text: str, language: str) -> Facts:
    """A broken file gives what can be read of it, and ``has_error``."""
    if language in EXTRACTORS:
        return EXTRACTORS[language](text)
    if language == "python":
        try:
            return python_ast.extract(text)
        except (SyntaxError, ValueError, RecursionError):
            out = lexer.extract(text, language)
            out.has_error = True
            return out
    return lexer.extract(text, language)


def _row(text: str, language: str) -> tuple:
    f = facts_of(text, language)
    lines = text.split("\n")
    code = [k for k, x in enumerate(lines, 1) if x.strip() and k not in f.comment_lines]
    sloc = set(code)
    functions = [(n, a, b, cy, cg, s or sum(k in sloc for k in range(a, b + 1))) for n, a, b, cy, cg, s in f.functions]
    as_dicts = lambda rows, *names: [dict(zip(names, r, strict=True)) for r in rows]
    return (
        as_dicts(dict.fromkeys(f.definitions), "name", "kind", "line", "end_line", "signature", "exported"), as_dicts(f.calls, "from_name", "to_name", "line"), as_dicts(f.refs, "name", "line", "col", "kind"), f.imports,
        as_dicts(f.relations, "name", "extends", "implements", "line"), as_dicts(functions, "name", "line", "end_line", "cyclomatic", "cognitive", "sloc"),
        len(lines), len(code), len(f.comment_lines), f.top_decisions, f.has_error,
    )


def extract_files(files: DataFrame) -> DataFrame:
    """One nested row for each file of source code (P1) that isn't too long (P2). One pass per file makes all facts and metrics."""
    some = files.filter(F.col("language").isin(*SPECS) & F.col("text").isNotNull())
    if LIMITS.source_chars:
        some = some.filter(F.length("text") <= LIMITS.source_chars)
    base = some.select("repo_key", "path", "language", "content_hash", "text")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(NESTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for b in batches:
            rows = [_row(t, lang) for t, lang in zip(b.column(4).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = list(b.columns[:4]) + [pa.array([r[k] for r in rows], arrow.field(k + 4).type) for k in range(11)]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return base.mapInArrow(run, schema)


def too_long(files: DataFrame) -> DataFrame:
    """Source files that are left out."""
    return files.filter(F.col("language").isNotNull() & (F.length("text") > F.lit(LIMITS.source_chars or 1 << 40)))


def definitions(nested: DataFrame) -> DataFrame:
    return nested.select("repo_key", "path", F.posexplode("definitions").alias("def_ord", "d")).select("repo_key", "path", "def_ord", "d.*")


def calls(nested: DataFrame) -> DataFrame:
    return nested.select("repo_key", "path", F.posexplode("calls").alias("call_ord", "c")).select("repo_key", "path", "call_ord", "c.*")


def references(nested: DataFrame) -> DataFrame:
    return nested.select("repo_key", "path", F.posexplode("refs").alias("ref_ord", "r")).select("repo_key", "path", "ref_ord", "r.*")


def imports(nested: DataFrame) -> DataFrame:
    return nested.select("repo_key", "path", F.posexplode("imports").alias("imp_ord", "spec"))


def class_relations(nested: DataFrame) -> DataFrame:
    return nested.select("repo_key", "path", F.posexplode("relations").alias("rel_ord", "r")).select("repo_key", "path", "rel_ord", "r.*")


def function_metrics(nested: DataFrame) -> DataFrame:
    return nested.select("repo_key", "path", F.posexplode("functions").alias("fn_ord", "f")).select("repo_key", "path", "fn_ord", "f.*")


def file_metrics(nested: DataFrame) -> DataFrame:
    """M3, M4: functions summed in the row itself."""
    total = lambda c: F.aggregate("functions", F.lit(0), lambda acc, f: acc + f[c])
    most = F.coalesce(F.array_max(F.transform("functions", lambda f: f["cyclomatic"])), F.lit(0))
    return nested.select("repo_key", "path", "language", (total("cyclomatic") + F.col("top_decisions")).alias("cyclomatic"), total("cognitive").alias("cognitive"), "total_lines", "sloc", "comment_lines", most.alias("max_function_complexity"))
