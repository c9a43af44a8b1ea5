"""Scalar functions over POSIX paths, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X


def segments(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def dirname(path: Column) -> Column:
    """Without the last segment; empty at the root."""
    return F.array_join(F.slice(segments(path), F.lit(1), F.size(segments(path)) - 1), "/")


def extension(path: Column) -> Column:
    """After the last dot, in lower case; the whole name if it has no dot."""
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def depth(path: Column) -> Column:
    return F.size(segments(path)) - 1


def stem(path: Column) -> Column:
    """the base name up to its first dot, in lower case."""
    return F.lower(F.substring_index(basename(path), ".", 1))


def normalize(path: Column) -> Column:
    """``.`` and empty segments dropped, ``..`` taking away the segment before it."""
    none = F.array().cast("array<string>")
    step = lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s))
    return F.array_join(F.aggregate(segments(path), none, step), "/")


def ancestors(path: Column) -> Column:
    """All directories above a path, outermost first; none at the root."""
    parts = segments(path)
    some = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(F.size(parts) > 1, some).otherwise(F.array().cast("array<string>"))


def suffixes(path: Column) -> Column:
    """The path and what is left of it after each slash."""
    parts = segments(path)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def contains_segments(path: Column, wanted: Column) -> Column:
    """whether the segments of ``wanted`` stand in a row in ``path``, whatever their case."""
    slash = F.lit("/")
    return (wanted != "") & F.contains(F.concat(slash, F.lower(path), slash), F.concat(slash, F.lower(wanted), slash))


def language(path: Column) -> Column:
    """The language of a file by its extension; null if it isn't one of source code."""
    table = F.create_map(*[F.lit(x) for pair in X.LANGUAGES.items() for x in pair])
    return F.try_element_at(table, extension(path))


def is_binary(path: Column) -> Column:
    """S17."""
    return extension(path).isin(*X.BINARY_EXTENSIONS)


def preview_kind(path: Column) -> Column:
    """S19."""
    return F.when(extension(path).isin("md", "markdown"), "markdown").when(is_binary(path), "binary").when(language(path).isNotNull(), "code").otherwise("unsupported")


def is_test(path: Column) -> Column:
    """P3."""
    return path.rlike(X.TEST_PATH)


def is_vendor(path: Column) -> Column:
    """P4."""
    return path.rlike(X.VENDOR_PATH)


def is_entry(path: Column) -> Column:
    """P4."""
    return path.rlike(X.ENTRY_PATH)


def target_score(path: Column) -> Column:
    """how likely a file is to matter."""
    part = lambda pattern, points: F.when(path.rlike(pattern), points).otherwise(0)
    return F.lit(X.PATH_BASE) - X.PATH_DEPTH * depth(path) + part(X.CORE_PATH, X.PATH_CORE) + part(X.ENTRY_PATH, X.PATH_ENTRY) - part(X.TESTY_PATH, X.PATH_TESTY)


def purpose_of_name(name: Column) -> Column:
    """the purpose that a directory's name tells; null if it tells none."""
    pairs: dict[str, str] = {}
    for key, names in X.PURPOSES.items():
        for n in names:
            pairs.setdefault(n, key)
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.try_element_at(table, F.lower(name))


def module_of(path: Column) -> Column:
    """The module of a file."""
    parts = segments(path)
    nested = (F.size(parts) >= 3) & F.lower(F.get(parts, F.lit(0))).isin(*X.MODULE_HEADS)
    return F.when(F.size(parts) == 1, "(root)").when(nested, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))


def first_dir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("(root)")


def _tails(full: bool) -> tuple[str, ...]:
    tails = ("", *(f".{e}" for e in X.IMPORT_EXTENSIONS), ".d.ts", *(f"/{i}.{e}" for i in X.INDEX_FILES for e in X.IMPORT_EXTENSIONS))
    return tails if full else X.RANK_SUFFIXES


def relative_candidates(base: Column, full: bool = True) -> Column:
    """F8: the paths that an import of ``base`` may mean, in order of preference; ``full``: all 94, else the 10 of ranking."""
    return F.array(*[F.concat(base, F.lit(t)) if t else base for t in _tails(full)])


def relative_bases(path: Column, full: bool = True) -> Column:
    """F8 the other way round: array<struct<base, pos>>, the bases that have ``path`` at place ``pos`` of their candidates. A file has few of them."""
    tails = F.array(*[F.struct(F.lit(t).alias("tail"), F.lit(k).alias("pos")) for k, t in enumerate(_tails(full))])
    has = F.filter(tails, lambda t: F.endswith(path, t["tail"]))
    return F.transform(has, lambda t: F.struct(F.substring(path, F.lit(1), F.length(path) - F.length(t["tail"])).alias("base"), t["pos"].alias("pos")))


def zip_path(raw: Column) -> Column:
    """A safe relative path from a ZIP entry's name; null if the name is unsafe or empty."""
    p = F.translate(raw, "\\", "/")
    parts = F.filter(segments(p), lambda s: (s != "") & (s != "."))
    unsafe = p.startswith("/") | p.rlike("^[a-zA-Z]:") | F.exists(parts, lambda s: (s == "..") | s.rlike(X.DEVICE_NAME)) | (F.size(parts) == 0)
    return F.when(~unsafe, F.array_join(parts, "/"))


def is_safe_relative(path: Column) -> Column:
    """Neither absolute, nor with a drive or a parent segment."""
    p = F.translate(path, "\\", "/")
    return ~(p.startswith("/") | p.rlike("^[a-zA-Z]:") | F.array_contains(segments(p), ".."))
