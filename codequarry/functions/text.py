"""Scalar functions over text, as native column expressions, but for the content hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed as X


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once per row; a lambda variable can't be inlined by the optimizer."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def estimate_tokens(text: Column) -> Column:
    """the weighted count of characters by class, rounded up; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    return F.ceil(token_weight(t)).cast("long")


def token_weight(text: Column) -> Column:
    """The sum before rounding; additive over concatenation, so running sums price every prefix."""
    alnum, space, cjk = _count(text, "0-9A-Za-z_"), _count(text, r" \n\t\r"), _count(text, X.CJK)
    other = F.length(text) - alnum - space - cjk
    return alnum * F.lit(X.W_ALNUM) + space * F.lit(X.W_SPACE) + other * F.lit(X.W_PUNCT) + cjk * F.lit(X.W_CJK)


def fits_budget(text: Column, budget: Column | int) -> Column:
    """F2."""
    return estimate_tokens(text) <= F.lit(X.BUDGET_SHARE) * (budget if isinstance(budget, Column) else F.lit(budget))


def _code_units(text: Column) -> Column:
    """The UTF-16 code units of a string: four hex digits each of its encoding, cut in one pass."""
    cut = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit(".{4}"), F.lit(0))
    return F.transform(cut, lambda u: F.conv(u, 16, 10).cast("long"))


def _fnv1a_of(texts: pa.Array) -> pa.Array:
    """All texts of a batch in step, a code unit of each at a time; of the last few, which are the longest, each by itself."""
    live = np.flatnonzero(np.asarray(texts.is_valid()))
    data = [t.decode("utf-8", "replace").encode("utf-16-le") for t in texts.cast(pa.binary()).to_pylist() if t is not None]
    size = np.array([len(t) // 2 for t in data], np.int64)
    units, start = np.frombuffer(b"".join(data), "<u2").astype(np.uint32), np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    start, size, h = start[order], size[order], np.full(size.size, 0x811C9DC5, np.uint32)
    # a unit of work each place, for as many texts as reach it
    done, longest = 0, int(size[_FNV_FEW]) if size.size > _FNV_FEW else 0
    reach = np.searchsorted(-size, -np.arange(longest), "left")
    while done < longest:
        n = int(reach[done])
        at = start[:n] + done
        until = int(np.searchsorted(-reach, -n, "right"))
        for _ in range(done, until):
            h[:n] = (h[:n] ^ units[at]) * np.uint32(0x01000193)
            at += 1
        done = until
    for k in range(min(_FNV_FEW, size.size)):
        x = int(h[k])
        for u in units[start[k] + min(longest, size[k]) : start[k] + size[k]].tolist():
            x = ((x ^ u) * 0x01000193) & 0xFFFFFFFF
        h[k] = x
    out = np.full(len(texts), None, object)
    out[live[order]] = [f"{x:08x}" for x in h.tolist()]
    return pa.array(out, pa.string())


#: So many texts of a batch are hashed one by one where all others have ended.
_FNV_FEW = 16


@F.arrow_udf(StringType())
def _fnv1a(texts: pa.Array) -> pa.Array:
    return _fnv1a_of(texts)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as 8 hex digits; by batches of texts."""
    return _fnv1a(text)


def short_id(text: Column) -> Column:
    """``n`` and the 32-bit hash h * 33 + c over code units, seed 5381, in base 36."""
    h = F.aggregate(_code_units(text), F.lit(5381).cast("long"), lambda acc, u: (acc * 33 + u).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.concat(F.lit("n"), F.lower(F.conv(h.cast("string"), 10, 36)))


def query_terms(query: Column) -> Column:
    """the distinct search terms of a query in order of appearance."""
    spaced = F.regexp_replace(F.regexp_replace(query, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    terms = F.transform(F.split(spaced, r"[^A-Za-z0-9\x{4E00}-\x{9FFF}]+"), lambda t: F.lower(t))
    return F.array_distinct(F.filter(terms, lambda t: (F.length(t) >= 2) & ~t.isin(*X.FOCUS_STOP_WORDS)))


def is_cjk(term: Column) -> Column:
    return term.rlike(r"[\x{4E00}-\x{9FFF}]")


def _best(terms: Column, score) -> Column:
    """The first term of the highest score as (score, hit); (0, null) if none scores. CJK terms don't take part."""

    def step(acc: Column, t: Column) -> Column:
        s = F.when(is_cjk(t), F.lit(0.0)).otherwise(score(t))
        better = s > acc["score"]
        return F.struct(F.when(better, s).otherwise(acc["score"]).alias("score"), F.when(better, t).otherwise(acc["hit"]).alias("hit"))

    return F.aggregate(terms, F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("hit")), step)


def score_name(name: Column, terms: Column) -> Column:
    """F11 for symbol names."""
    low = F.lower(name)
    return _best(terms, lambda t: F.when(low == t, X.NAME_EQUAL).when(low.startswith(t), X.NAME_PREFIX).when(F.contains(low, t), X.NAME_INSIDE).otherwise(0.0))


def score_path(path: Column, terms: Column) -> Column:
    """F11 for paths."""
    low = F.lower(path)
    segment = lambda t: F.exists(F.split(low, "/"), lambda s: (s == t) | (F.regexp_replace(s, r"\.[a-z0-9]+$", "") == t))
    return _best(terms, lambda t: F.when(segment(t), X.PATH_SEGMENT).when(F.contains(low, t), X.PATH_INSIDE).otherwise(0.0))


def _locate(what: Column, text: Column, start: Column) -> Column:
    return F.call_function("locate", what, text, start)


def fuzzy_score(query: Column, text: Column) -> Column:
    """the score of the greedy subsequence match, null if the text lacks a character; 0 for an empty query.

    The state is (score, last hit, cursor, first hit); each character of the query is looked for from the cursor on.
    """
    low = F.lower(text)
    chars = F.filter(F.split(F.lower(query), ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        at = _locate(c, low, acc["cursor"] + 1) - 1
        before, here = F.substring(text, at, F.lit(1)), F.substring(text, at + 1, F.lit(1))
        boundary = (at == 0) | before.rlike(r"[\s/_\-.]") | (before.rlike("[a-z0-9]") & here.rlike("[A-Z]"))
        gained = (
            F.lit(X.FUZZY_HIT)
            + F.when(at == acc["last"] + 1, X.FUZZY_RUN).otherwise(0)
            + F.when(boundary, X.FUZZY_BOUNDARY).otherwise(0)
            - F.least(at - acc["cursor"], F.lit(X.FUZZY_GAP))
        )
        ok = acc["ok"] & (at >= 0)
        return F.struct(
            ok.alias("ok"), F.when(ok, acc["score"] + gained).otherwise(acc["score"]).alias("score"), at.alias("last"), (at + 1).alias("cursor"),
            F.when(acc["first"] < 0, at).otherwise(acc["first"]).alias("first"),
        )

    zero = F.struct(F.lit(True).alias("ok"), F.lit(0).alias("score"), F.lit(-2).alias("last"), F.lit(0).alias("cursor"), F.lit(-1).alias("first"))
    length_cost = F.least(F.floor(F.length(text) / 8).cast("int"), F.lit(X.FUZZY_LENGTH))
    done = F.aggregate(chars, zero, step, lambda a: F.when(a["ok"], a["score"] + F.greatest(F.lit(0), F.lit(X.FUZZY_EARLY) - a["first"]) - length_cost))
    return F.when(query == "", F.lit(0)).otherwise(done)


def type_name(name: Column) -> Column:
    """F16: the last segment of a type's name without modifiers, type arguments, brackets and parentheses."""
    bare = F.regexp_replace(name, r"\b(public|protected|private|virtual|static|abstract|final|sealed)\b", " ")
    for inner in (r"<[^<>]*>", r"\[[^\]]*\]", r"\([^()]*\)"):
        bare = F.regexp_replace(bare, inner, " ")
    parts = F.filter(F.split(bare, r"[.:\s]+"), lambda s: s != "")
    return F.regexp_replace(F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(F.lit("")), r"[^A-Za-z0-9_$]", "")


def type_names(names: Column) -> Column:
    """F16: the names in a comma-separated list."""
    return F.filter(F.transform(F.split(names, ","), type_name), lambda n: n != "")


def one_line(text: Column) -> Column:
    """white space collapsed, backticks as apostrophes."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "`", "'"))


def clip_list(items: Column, most: int = 8) -> Column:
    """the first ``most`` items, and how many there are if more."""
    shown = F.array_join(F.slice(items, 1, most), ", ")
    return F.when(F.size(items) > most, F.concat(shown, F.lit(" … ("), F.size(items).cast("string"), F.lit(")"))).otherwise(shown)


def _replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_html(text: Column) -> Column:
    """F22 for HTML."""
    return _replaced(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")))


def escape_label(text: Column) -> Column:
    """F22 for diagram labels."""
    return _replaced(text, (('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("[", "("), ("]", ")"), ("{", "("), ("}", ")"), ("|", "/")))


def clean_address(address: Column) -> Column:
    """an address without surrounding quotes and backticks and one closing CJK mark."""
    quotes = "`'\"\u201c\u201d\u2018\u2019"
    bare = F.regexp_replace(F.trim(address), f"^[{quotes}]+|[{quotes}]+$", "")
    return F.trim(F.regexp_replace(bare, "[\uff0c\u3002\uff1b\u3001]$", ""))


def file_of_address(address: Column) -> Column:
    """the path of an address with lines, or of an ``index:`` address; else the address."""
    lines = F.regexp_extract(address, r"^(.+?):\d+(?:-\d+)?$", 1)
    return F.when(lines != "", lines).when(address.startswith("index:"), F.substring(address, 7, 1 << 30)).otherwise(address)


def marker_addresses(text: Column) -> Column:
    """The addresses of a text's marker lines, in their order."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(X.MARKER_LINE))
    return F.transform(lines, lambda x: F.regexp_extract(x, X.MARKER_LINE, 1))


def rotate_to_least(items: Column) -> Column:
    """an array turned so that its least element comes first."""
    at = F.array_position(items, F.array_min(items)).cast("int")
    return F.when(F.size(items) == 0, items).otherwise(F.concat(F.slice(items, at, F.size(items)), F.slice(items, F.lit(1), at - 1)))


def relative_url(url: Column, base_dir: Column) -> Column:
    """absolute, data and blob URLs as they are; others below ``base_dir`` without ``./`` and ``../``."""
    kept = url.rlike(r"(?i)^([a-z][a-z0-9+.-]*:|//|#)")
    bare = F.regexp_replace(url, r"^(\./|\.\./|/)+", "")
    return F.when(kept, url).when(base_dir == "", bare).otherwise(F.concat_ws("/", base_dir, bare))
