"""The functions of this package for SQL: ``register(spark)``, then for example

    SELECT path, estimate_tokens(text), content_hash(text) FROM files
    SELECT f.path, x.* FROM files f, LATERAL extract_facts(f.path, f.language, f.text) x WHERE x.fact = 'definition'

Scalar functions are SQL functions: Spark puts their bodies in place of the calls, so they are native like the column expressions
and equal to them (tests compare both). Extraction is a table function over whole texts, as is the text of a range of lines.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import fixed as X


def _chars(t: str, chars: str) -> str:
    return f"regexp_count({t}, r'[{chars}]')"


def _units(t: str) -> str:
    return f"transform(regexp_extract_all(hex(encode({t}, 'UTF-16BE')), '.{{4}}', 0), u -> CAST(conv(u, 16, 10) AS BIGINT))"


_OTHER = f"(length(t) - {_chars('t', '0-9A-Za-z_')} - {_chars('t', ' \\n\\t\\r')} - {_chars('t', X.CJK)})"
_WEIGHT = f"({_chars('t', '0-9A-Za-z_')} * {X.W_ALNUM}D + {_chars('t', ' \\n\\t\\r')} * {X.W_SPACE}D + {_OTHER} * {X.W_PUNCT}D + {_chars('t', X.CJK)} * {X.W_CJK}D)"

# the greedy match of F12: for each character of the query its place at or after the cursor, the score that it adds, and where the next may stand
_STEP = f"""named_struct(
 'ok', a.ok AND p.at > 0,
 'score', CASE WHEN a.ok AND p.at > 0 THEN a.score + {X.FUZZY_HIT} + CASE WHEN p.at - 1 = a.last + 1 THEN {X.FUZZY_RUN} ELSE 0 END
   + CASE WHEN p.at = 1 OR p.before RLIKE r'[\\s/_\\-.]' OR (p.before RLIKE '[a-z0-9]' AND p.here RLIKE '[A-Z]') THEN {X.FUZZY_BOUNDARY} ELSE 0 END - least(p.at - 1 - a.cursor, {X.FUZZY_GAP}) ELSE a.score END,
 'last', p.at - 1, 'cursor', p.at, 'first', CASE WHEN a.first < 0 THEN p.at - 1 ELSE a.first END)"""
_AT = "locate(c, lower(t), a.cursor + 1)"
_PLACE = f"named_struct('at', {_AT}, 'before', substring(t, {_AT} - 1, 1), 'here', substring(t, {_AT}, 1))"

#: name -> (parameters, type, body)
SCALARS = {
    "estimate_tokens": ("t STRING", "BIGINT", f"coalesce(CAST(ceil({_WEIGHT}) AS BIGINT), 0)"),
    "fits_budget": ("t STRING, budget INT", "BOOLEAN", f"estimate_tokens(t) <= {X.BUDGET_SHARE}D * budget"),
    "content_hash": ("t STRING", "STRING", f"lpad(lower(hex(aggregate({_units('t')}, 2166136261L, (h, u) -> ((h ^ u) * 16777619L) & 4294967295L))), 8, '0')"),
    "short_id": ("t STRING", "STRING", f"concat('n', lower(conv(CAST(aggregate({_units('t')}, 5381L, (h, u) -> (h * 33L + u) & 4294967295L) AS STRING), 10, 36)))"),
    "fuzzy_score": (
        "q STRING, t STRING",
        "INT",
        f"""CASE WHEN q = '' THEN 0 ELSE aggregate(filter(split(lower(q), ''), c -> c <> ''), named_struct('ok', true, 'score', 0, 'last', -2, 'cursor', 0, 'first', -1),
 (a, c) -> element_at(transform(array({_PLACE}), p -> {_STEP}), 1),
 a -> CASE WHEN a.ok THEN a.score + greatest(0, {X.FUZZY_EARLY} - a.first) - least(CAST(floor(length(t) / 8) AS INT), {X.FUZZY_LENGTH}) END) END""",
    ),
}

FACTS = "fact string, ord int, name string, kind string, line int, end_line int, other string, exported boolean, cyclomatic int, cognitive int, sloc int"
SLICE = "text string, start_line int, end_line int, tokens int, truncated boolean, total_lines int"


@udtf(returnType=FACTS)
class ExtractFacts:
    """Rows of six kinds of facts: definition, call (``other`` is the caller), reference, import, relation (``other``: what it extends | what it implements), function."""

    def eval(self, path: str, language: str, text: str) -> Iterator[tuple]:
        from ..extract.driver import _row
        from ..extract.spec import SPECS

        if text is None or language not in SPECS:
            return
        definitions, calls, refs, imports, relations, functions, *_ = _row(text, language)
        none = (None,) * 4
        for i, d in enumerate(definitions):
            yield ("definition", i, d["name"], d["kind"], d["line"], d["end_line"], d["signature"], d["exported"], None, None, None)
        for i, c in enumerate(calls):
            yield ("call", i, c["to_name"], None, c["line"], None, c["from_name"], *none)
        for i, r in enumerate(refs):
            yield ("reference", i, r["name"], r["kind"], r["line"], None, str(r["col"]), *none)
        for i, spec in enumerate(imports):
            yield ("import", i, spec, None, None, None, None, *none)
        for i, r in enumerate(relations):
            yield ("relation", i, r["name"], None, r["line"], None, f"{','.join(r['extends'])}|{','.join(r['implements'])}", *none)
        for i, f in enumerate(functions):
            yield ("function", i, f["name"], None, f["line"], f["end_line"], None, None, f["cyclomatic"], f["cognitive"], f["sloc"])


@udtf(returnType=SLICE)
class SliceText:
    """The numbered lines of a range, cut to a budget; a null end means the whole file."""

    def eval(self, text: str, path: str, start: int, end: int, label: str, max_tokens: int) -> Iterator[tuple]:
        from ..operators.navigation import slice_text

        if text is not None and start is not None:
            yield slice_text(text, path or "", start, end, label, max_tokens if max_tokens is not None else 800)


def register(spark: SparkSession) -> None:
    """All functions for this session, under their names above and ``extract_facts`` and ``slice_text``."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("extract_facts", ExtractFacts)
    spark.udtf.register("slice_text", SliceText)
