"""Context packs of all repositories at once, a row each.

How many symbols fit is found without rendering: each line's characters are counted by class, running sums price every prefix of
a repository's lines, and each layer of blocks adds its own counts. What is ordered or gathered by repository is bounded by the
budget or by fixed numbers of rows: ranks come from ranges of their order, and ``row_number() <= k`` is cut before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import fixed as X
from ..functions import paths
from ..operators import graphs, modules, resolve, symbols
from ..operators.numbering import numbered
from ..sources import tree
from ..storage import Tables
from . import pack as P

INTENTS = ("overview", "api")
#: Classes of characters that have a weight of their own; all others weigh as punctuation.
_CLASSES = {"alnum": ("0-9A-Za-z_", X.W_ALNUM), "space": (r" \n\t\r", X.W_SPACE), "other": (None, X.W_PUNCT), "cjk": (X.CJK, X.W_CJK)}
_TITLE = "\n\n## Symbols\n\n"
#: A layer is passed over if fewer symbols than this fit, where there are as many.
WANTED = 5


def _counts(t: Column) -> dict[str, Column]:
    found = {c: F.regexp_count(t, F.lit(f"[{chars}]")) for c, (chars, _) in _CLASSES.items() if chars}
    found["other"] = F.length(t) - found["alnum"] - found["space"] - found["cjk"]
    return {c: found[c].cast("long") for c in _CLASSES}


def _tokens(counts: dict[str, Column]) -> Column:
    """F1 of a text with these counts: the same sum of products, so it rounds as the estimate of the whole text does."""
    a, s, o, c = (counts[k] * F.lit(w) for k, (_, w) in _CLASSES.items())
    return F.ceil(a + s + o + c).cast("long")


def note(included: Column, total: Column, files: Column) -> Column:
    """X12."""
    return F.concat(F.lit("_"), included.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" symbols in "), files.cast("string"), F.lit(" files._"))


@F.pandas_udf(StringType())
def _shrunk(markdown: pd.Series, budget: pd.Series) -> pd.Series:
    return pd.Series([None if m is None else P.shrink(m, b) for m, b in zip(markdown, budget)], dtype=object)


def fit_layers(lines: DataFrame, layers: DataFrame, budget: int, least: float = X.W_SPACE) -> DataFrame:
    """(repo_key, layer, included, files, total, tokens, min_tokens, markdown), a row for each repository of ``layers``.

    ``lines``: (repo_key, rank, path, line), ``rank`` from 1 on without gaps. ``layers``: (repo_key, layer, fixed), the richest first, from 0
    on. Taken is the first layer with which ``WANTED`` lines or all lines fit, else the last one, with as many lines as fit into 95 % of the
    budget with the layer's text and the note of what is left out. If not even the last layer fits, its end is cut off.
    ``least``: a line weighs no less, its line break included, so lines of higher rank than could fit are never gathered.
    Lines of repositories without layers are passed over, as are null keys; a repository without lines has its first layer that fits.
    """
    limit = X.BUDGET_SHARE * budget
    total = lines.groupBy("repo_key").agg(F.count(F.lit(1)).alias("total"))
    some = lines.filter(F.col("rank") <= int(limit / least) + 1).select("repo_key", "rank", "path", "line")
    up_to = Window.partitionBy("repo_key").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    new = (F.col("rank") == F.min("rank").over(Window.partitionBy("repo_key", "path"))).cast("long")
    some = some.withColumn("new", new).withColumns(_counts(F.concat("line", F.lit("\n"))))
    priced = some.select("repo_key", F.col("rank").cast("long").alias("n"), F.sum("new").over(up_to).alias("cover"), *[F.sum(c).over(up_to).alias(c) for c in _CLASSES])

    fixed = layers.join(total, "repo_key", "left").fillna(0, ["total"])
    fixed = fixed.select("repo_key", "layer", "total", *[v.alias(f"fixed_{c}") for c, v in _counts(F.col("fixed")).items()])
    none = layers.select("repo_key").distinct().select("repo_key", *[F.lit(0).cast("long").alias(c) for c in ("n", "cover", *_CLASSES)])
    each = fixed.join(priced.unionByName(none), "repo_key")
    title = _counts(F.lit(_TITLE))
    told = F.when(F.col("n") < F.col("total"), F.concat(F.lit("\n\n"), note(F.col("n"), F.col("total"), F.col("cover")))).otherwise("")
    # the last line has no line break of its own
    body = {c: F.when(F.col("n") > 0, F.col(c) + title[c] - int(c == "space")).otherwise(0) for c in _CLASSES}
    tokens = _tokens({c: F.col(f"fixed_{c}") + body[c] + v for c, v in _counts(told).items()})
    each = each.select("repo_key", "layer", "total", "n", "cover", tokens.alias("tokens"))
    best = each.groupBy("repo_key", "layer", "total").agg(
        F.max(F.when(F.col("tokens") <= limit, F.struct("n", "cover", "tokens"))).alias("fit"), F.min_by("tokens", "n").alias("bare")
    )
    ok = F.col("fit.n") >= F.least(F.lit(WANTED), F.col("total"))
    chosen = best.groupBy("repo_key").agg(
        F.min(F.when(ok, F.struct("layer", "fit"))).alias("rich"), F.max(F.struct("layer", "fit")).alias("last"), F.first("total").alias("total"), F.max_by("bare", "layer").alias("min_tokens")
    )
    chosen = chosen.withColumn("c", F.coalesce("rich", "last")).select(
        "repo_key", F.col("c.layer").alias("layer"), F.coalesce("c.fit.n", F.lit(0)).alias("included"), F.coalesce("c.fit.cover", F.lit(0)).alias("files"), "total", "min_tokens", F.col("c.fit").isNotNull().alias("fits")
    )
    shown = some.join(chosen, "repo_key").filter(F.col("rank") <= F.col("included")).groupBy("repo_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("shown"))
    whole = chosen.join(layers.select("repo_key", "layer", "fixed"), ["repo_key", "layer"]).join(shown, "repo_key", "left")
    rest = F.when(F.col("included") < F.col("total"), F.concat(F.lit("\n\n"), note(F.col("included"), F.col("total"), F.col("files")))).otherwise("")
    text = F.concat("fixed", F.coalesce(F.concat(F.lit(_TITLE), "shown"), F.lit("")), rest)
    text = F.when(F.col("fits"), text).otherwise(_shrunk(F.when(~F.col("fits"), text), F.lit(budget)))
    out = whole.withColumn("markdown", text)
    return out.select("repo_key", "layer", "included", "files", "total", _tokens(_counts(F.col("markdown"))).alias("tokens"), "min_tokens", "markdown")


def top(df: DataFrame, order: Sequence[Column | str], most: int, by: Sequence[str] = ("repo_key",)) -> DataFrame:
    """The first ``most`` rows of each group, with their number ``k`` from 1 on."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("k") <= most)


def joined(df: DataFrame, text: Column, sep: str, by: Sequence[str] = ("repo_key",)) -> DataFrame:
    """(by, text): the texts of a bounded group, by ``k``."""
    return df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))), lambda x: x["t"]), sep).alias("text"))


def _quoted(c: Column | str) -> Column:
    return F.concat(F.lit("`"), c, F.lit("`"))


def _s(c: str) -> Column:
    return F.col(c).cast("string")


class Blocks:
    """The blocks of every repository, each a table (repo_key, text); a repository that has nothing to show in one has no row in it."""

    def __init__(self, files: DataFrame, definitions: DataFrame, calls: DataFrame, ranked: DataFrame, edges: DataFrame, tables: Tables):
        self.files, self.definitions, self.calls, self.ranked, self.edges, self.tables = files, definitions, calls, ranked, edges, tables
        self.best = ranked.groupBy("repo_key", "path").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"))

    @staticmethod
    def sections(parts: Sequence[tuple[str, DataFrame]], sep: str = "\n\n") -> DataFrame:
        """One text of several, in this order, each after its title."""
        every = None
        for k, (title, t) in enumerate(parts):
            one = t.select("repo_key", F.lit(k).alias("k"), F.concat(F.lit(title), "text").alias("part"))
            every = one if every is None else every.unionByName(one)
        return joined(every, F.col("part"), sep)

    def header(self) -> DataFrame:
        languages = self.files.groupBy("repo_key", F.coalesce("language", F.lit("other")).alias("language")).agg(F.count(F.lit(1)).alias("n"))
        mix = joined(top(languages, [F.desc("n"), "language"], 8), F.concat("language", F.lit(" "), _s("n")), ", ").withColumnRenamed("text", "mix")
        n = languages.groupBy("repo_key").agg(F.sum("n").alias("files"))
        d = self.ranked.groupBy("repo_key").agg(F.count(F.lit(1)).alias("symbols"))
        first = n.join(mix, "repo_key").join(d, "repo_key", "left").fillna(0, ["symbols"])
        first = first.select("repo_key", F.concat(F.lit("# "), "repo_key", F.lit("\n\n"), _s("files"), F.lit(" files, "), _s("symbols"), F.lit(" symbols. "), "mix").alias("text"))
        parts = [("", first)]
        if "text" in self.files.columns:
            m = tree.manifests(self.files)
            scripts = F.array_join(F.transform("scripts", lambda s: F.concat(F.lit("\n- `"), s["name"], F.lit("`: "), s["command"])), "")
            uses = F.when(F.size("dependencies") > 0, F.concat(F.lit("\nUses "), F.array_join("dependencies", ", "))).otherwise("")
            named = F.trim(F.concat_ws(" ", F.lit("Package"), F.coalesce("name", F.lit("")), F.coalesce("version", F.lit(""))))
            parts.append(("", m.groupBy("repo_key").agg(F.min(F.concat(named, scripts, uses)).alias("text"))))
        parts.append(("Package manager: ", tree.package_manager(self.files).select("repo_key", F.col("manager").alias("text"))))
        parts.append(("Entry files: ", joined(tree.entry_files(self.files).withColumnRenamed("rank", "k"), _quoted("path"), ", ")))
        return self.sections(parts, "\n")

    def structure(self) -> DataFrame:
        purposes = top(modules.directory_purposes(self.files), ["dir"], P.DIR_PURPOSES)
        keyed = top(self.best.withColumn("module", paths.module_of(F.col("path"))), ["rank", "path"], P.KEY_FILES_EACH, ["repo_key", "module"])
        shown = joined(keyed, _quoted("path"), ", ", ["repo_key", "module"])
        sizes = self.best.groupBy("repo_key", paths.module_of(F.col("path")).alias("module")).agg(F.count(F.lit(1)).alias("files"), F.min("rank").alias("rank"))
        per = top(sizes.join(shown, ["repo_key", "module"]), ["rank", "module"], P.MODULES)
        names = self.ranked.filter("exported").groupBy("repo_key", "name").agg(F.min("rank").alias("rank"))
        root = top(self.files.filter(~F.contains("path", F.lit("/"))), ["path"], P.CONFIG_FILES)
        return self.sections([
            ("## Structure\n\n", joined(purposes, F.concat(F.lit("- `"), "dir", F.lit("/` "), "purpose"), "\n")),
            ("### Modules\n", joined(per, F.concat(F.lit("- "), _quoted("module"), F.lit(" "), _s("files"), F.lit(" files: "), "text"), "\n")),
            ("### Exported\n", joined(top(names, ["rank"], P.EXPORTED), F.col("name"), ", ")),
            ("### Key files\n", joined(top(self.best, ["rank"], P.KEY_FILES), F.concat(F.lit("- "), _quoted("path"), F.lit(" "), _s("n"), F.lit(" symbols")), "\n")),
            ("### At the root\n", joined(root, _quoted("path"), ", ")),
        ])

    def skeleton(self) -> DataFrame:
        nodes = top(modules.modules(self.files), [F.desc("files"), "module"], P.SKELETON_MODULES)
        return self.sections([
            ("## Skeleton\n\n", joined(nodes, F.concat(F.lit("- "), _quoted("module"), F.lit(" "), _s("files"), F.lit(" files, "), "purpose"), "\n")),
            ("Key files: ", joined(top(self.best, ["rank"], P.SKELETON_FILES), _quoted("path"), ", ")),
        ], "\n")

    def reading(self) -> DataFrame:
        steps = graphs.reading_order(self.files, self.edges, tables=self.tables).filter(F.col("order") <= P.READING).withColumnRenamed("order", "k")
        role = F.lit(None).cast("string")
        for name, shown in P.ROLE_NAMES.items():
            role = F.when(F.col("role") == name, shown).otherwise(role)
        return self.sections([("## Reading order\n\n", joined(steps, F.concat(_s("k"), F.lit(". "), _quoted("path"), F.lit(" ("), role, F.lit(")")), "\n"))])

    def pairs(self, most: int) -> DataFrame:
        """(repo_key, k, from_name, to_name): distinct pairs of names, those of the most important callers first."""
        important = self.ranked.groupBy("repo_key", "path", F.col("name").alias("from_name")).agg(F.max("rank").alias("rank"))
        # calls of a pair in a file fold into one before they meet ranks
        own = self.calls.filter("from_name IS NOT NULL").groupBy("repo_key", "path", "from_name", "to_name").agg(F.min("call_ord").alias("ord")).join(important, ["repo_key", "path", "from_name"])
        known = self.definitions.select("repo_key", F.col("name").alias("to_name")).distinct()
        found = own.join(known, ["repo_key", "to_name"], "left_semi").groupBy("repo_key", "from_name", "to_name").agg(F.min("rank").alias("rank"), F.min("ord").alias("ord"))
        return top(found, ["rank", "ord", "from_name", "to_name"], most)

    def call_summary(self) -> DataFrame:
        return self.sections([("## Calls\n\n", joined(self.pairs(P.CALLS_TEXT), F.concat(F.lit("- "), "from_name", F.lit(" → "), "to_name"), "\n"))])


#: The blocks of each layer, the richest first.
LADDERS = {"overview": (("header", "structure", "reading", "call_summary"), ("header", "structure", "reading"), ("header", "structure"), ("header", "skeleton"), ("header",)), "api": (("header",),)}


def symbol_line() -> Column:
    """How a definition is shown: its place and name, and up to 120 characters of its signature on one line."""
    flat = F.substring(F.trim(F.regexp_replace(F.coalesce("signature", F.lit("")), r"\s+", " ")), 1, 120)
    return F.concat(F.lit("- `"), "path", F.lit(":"), _s("line"), F.lit("` "), "name", F.when(F.coalesce("signature", F.lit("")) != "", F.concat(F.lit(" — "), flat)).otherwise(""))


def layers_of(blocks: Blocks, intent: str) -> DataFrame:
    """(repo_key, layer, fixed): each block is made once, and goes to all layers that show it."""
    ladder = LADDERS[intent]
    every = None
    for k, name in enumerate(dict.fromkeys(b for layer in ladder for b in layer)):
        within = F.array(*[F.lit(i) for i, layer in enumerate(ladder) if name in layer])
        one = getattr(blocks, name)().select("repo_key", F.explode(within).alias("layer"), F.lit(k).alias("k"), "text")
        every = one if every is None else every.unionByName(one)
    return joined(every, F.col("text"), "\n\n", ["repo_key", "layer"]).withColumnRenamed("text", "fixed")


def repository_packs(files: DataFrame, definitions: DataFrame, calls: DataFrame, imports: DataFrame, intent: str = "overview", budget: int = 8000, ranked: DataFrame | None = None) -> DataFrame:
    """(repo_key, layer, included, files, total, tokens, min_tokens, markdown, json) of every repository that has files.

    ``overview`` shows the symbols of the highest ranks with structure, reading order and calls, ``api`` exported ones only. ``ranked``: definitions
    with ``rank`` from 1 on in each repository and ``score``, else those of ``graphs.rank_symbols``.
    """
    if intent not in INTENTS:
        raise ValueError(intent)
    tables = Tables(files.sparkSession, "packs")
    if ranked is None:
        refs = calls.groupBy("repo_key", F.col("to_name").alias("name")).agg(F.count(F.lit(1)).alias("refs"))
        ranked = graphs.rank_symbols(definitions, refs, graphs.file_ranks(imports, calls, definitions, files, tables=tables), tables)
    ranked = tables.write(ranked.filter("repo_key IS NOT NULL"))
    imported = tables.write(resolve.import_edges(resolve.resolve_imports(imports, files)))
    edges = tables.write(resolve.merge_edges(imported, resolve.call_edges(calls, definitions, imported)))
    blocks = Blocks(files.filter("repo_key IS NOT NULL"), definitions, calls, ranked, edges, tables)
    pool = ranked
    if intent == "api":
        pool = numbered(symbols.exported_only(ranked).withColumnRenamed("rank", "of_all"), [F.col("of_all").asc()], tables.write, "rank", by=["repo_key"]).withColumn("rank", F.col("rank") + 1).drop("of_all")
    layers = tables.write(layers_of(blocks, intent))
    fitted = tables.write(fit_layers(pool.withColumn("line", symbol_line()), layers, budget, least=P.LEAST_LINE))
    shown = pool.join(fitted.select("repo_key", "included"), "repo_key").filter(F.col("rank") <= F.col("included"))
    item = F.struct("name", F.col("path").alias("file"), "line", "kind", "exported", F.round("score", 6).alias("rank"))
    items = shown.groupBy("repo_key").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("k"), item.alias("x")))), lambda s: s["x"]).alias("symbols"))
    called = blocks.pairs(P.CALLS_JSON).groupBy("repo_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.struct(F.col("from_name").alias("from"), F.col("to_name").alias("to")).alias("x")))), lambda s: s["x"]).alias("calls"))
    # files with symbols by rank, then the others by path
    listed = top(files.select("repo_key", "path").join(blocks.best, ["repo_key", "path"], "left"), [F.col("rank").asc_nulls_last(), "path"], P.JSON_FILES)
    listed = listed.groupBy("repo_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda s: s["path"]).alias("listed"))
    out = fitted.join(items, "repo_key", "left").join(called, "repo_key", "left").join(listed, "repo_key", "left")
    empty = lambda c: F.coalesce(c, F.from_json(F.lit("[]"), items.schema["symbols"].dataType if c == "symbols" else called.schema["calls"].dataType))
    body = F.struct(F.col("repo_key").alias("name"), F.lit(intent).alias("intent"), F.lit(budget).alias("budget"), F.col("listed").alias("files"), empty("symbols").alias("symbols"), empty("calls").alias("calls"))
    return out.select(*fitted.columns, F.to_json(body).alias("json"))
