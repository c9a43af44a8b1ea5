"""From imports and calls to file edges.

The import resolver is a ladder of equi-joins: each step turns the specs that it understands into (spec, target), and
the first step that does wins. Specs are looked up once each per directory they are read from, not once per import.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import paths
from ..storage import Tables
from . import file_calls
from .numbering import dense_ids

KEY = ["repo_key"]


def clean_spec(spec: Column) -> Column:
    """Step 0: without quotes and semicolon; Python's leading dots as relative paths."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(spec), "^['\"`]|['\"`]$", ""), ";$", "")
    dots, rest = F.regexp_extract(bare, r"^(\.+)([A-Za-z_][\w.]*)$", 1), F.regexp_extract(bare, r"^(\.+)([A-Za-z_][\w.]*)$", 2)
    python = F.concat(F.when(F.length(dots) == 1, F.lit("./")).otherwise(F.repeat(F.lit("../"), F.length(dots) - 1)), F.replace(rest, F.lit("."), F.lit("/")))
    return F.when(dots != "", python).when(bare.rlike(r"^\.+$"), F.lit("./")).otherwise(bare)


def _relative(specs: DataFrame, files: DataFrame, full: bool) -> DataFrame:
    """The first candidate path that exists, by equi-join. Files name the few bases that may mean them, so no import is ever exploded into its 94 candidates."""
    base = paths.normalize(F.when(F.col("spec").startswith("/"), F.col("spec")).otherwise(F.concat(F.col("dir"), F.lit("/"), F.col("spec"))))
    asked = specs.select("repo_key", "dir", "spec").distinct().withColumn("base", base).filter(F.col("base") != "")
    meant = files.select("repo_key", F.col("path").alias("target"), F.explode(paths.relative_bases(F.col("path"), full)).alias("m"))
    hit = asked.join(meant.select("repo_key", "m.base", "m.pos", "target"), ["repo_key", "base"])
    return hit.groupBy("repo_key", "dir", "spec").agg(F.min_by("target", "pos").alias("target"))


def relative_imports(imports: DataFrame, files: DataFrame, full: bool = True) -> DataFrame:
    """(repo_key, path, imp_ord, target) of the relative imports that resolve to another file."""
    # the ranking graph takes a spec as written, the full resolver cleans it first
    own = imports.withColumn("spec", clean_spec(F.col("spec"))) if full else imports
    own = own.withColumn("dir", paths.dirname(F.col("path")))
    own = own.filter(F.col("spec").startswith(".") | (F.col("spec").startswith("/") if full else F.lit(False)))
    found = _relative(own, files, full)
    return own.join(found, ["repo_key", "dir", "spec"]).filter(F.col("target") != F.col("path")).select("repo_key", "path", "imp_ord", "target")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_key, path, imp_ord, target, step) of every import that resolves to another file of its repository.

    Steps: 1 relative path, 2 package entry, 3 module path by stem, 4 unique directory suffix.
    """
    own = imports.withColumn("spec", clean_spec(F.col("spec"))).filter(F.col("spec") != "")
    relative = own.filter(F.col("spec").rlike("^[./]"))
    named = own.filter(~F.col("spec").rlike("^[./]"))
    first = relative_imports(relative, files).withColumn("step", F.lit(1))

    # The first file that registers the package
    package = F.lower(F.when(F.col("spec").startswith("@"), F.get(F.split("spec", "/"), F.lit(1))).otherwise(F.get(F.split("spec", "/"), F.lit(0))))
    entries = files.withColumn("package", F.lower(F.regexp_extract("path", X.PACKAGE_ENTRY, 1))).filter(F.col("package") != "").groupBy("repo_key", "package").agg(F.min("path").alias("target"))
    second = named.withColumn("package", package).join(entries, ["repo_key", "package"]).filter(F.col("target") != F.col("path")).select("repo_key", "path", "imp_ord", "target", F.lit(2).alias("step"))

    # the module path: segments without leading aliases
    parts = F.filter(F.transform(F.split(F.translate("spec", "\\", "/"), "[.:/]+"), lambda s: F.trim(s)), lambda s: s != "")
    keep = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when((F.size(acc) == 0) & s.isin(*X.IMPORT_NOISE), acc).otherwise(F.array_append(acc, F.lower(s))))
    module = named.withColumn("parts", keep).filter(F.size("parts") > 0)
    asked = module.select("repo_key", "path", "imp_ord", "parts")

    # step 3: same stem; whole path in a row scores 2, the segment before the last among the directories 1
    stems = files.select("repo_key", F.col("path").alias("target"), paths.stem(F.col("path")).alias("stem"))
    cand = asked.withColumn("stem", F.element_at("parts", -1)).join(stems, ["repo_key", "stem"]).filter(F.col("target") != F.col("path"))
    dirs = F.lower(paths.dirname(F.col("target")))
    whole = F.when(dirs == "", F.col("stem")).otherwise(F.concat_ws("/", dirs, F.col("stem")))
    score = F.when(paths.contains_segments(whole, F.array_join("parts", "/")), 2).when((F.size("parts") >= 2) & F.array_contains(F.split(dirs, "/"), F.get("parts", F.size("parts") - 2)), 1).otherwise(0)
    scored = cand.withColumn("score", score).filter("score > 0").groupBy("repo_key", "path", "imp_ord", "score").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target"))
    third = scored.groupBy("repo_key", "path", "imp_ord").agg(F.max(F.struct("score", "n", "target")).alias("b")).filter("b.n = 1").select("repo_key", "path", "imp_ord", F.col("b.target").alias("target"), F.lit(3).alias("step"))

    # The last three to one segments as the suffix of one directory only; in it the file named so, or an index file
    dir_of = files.filter(F.contains("path", F.lit("/"))).select("repo_key", "path", F.lower(paths.dirname(F.col("path"))).alias("dir"))
    owners = dir_of.select("repo_key", "dir").distinct().select("repo_key", "dir", F.explode(paths.suffixes(F.col("dir"))).alias("suffix")).groupBy("repo_key", "suffix").agg(F.min("dir").alias("dir"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    takes = F.transform(F.sequence(F.least(F.lit(3), F.size("parts")), F.lit(1)), lambda n: F.array_join(F.slice("parts", F.size("parts") - n + 1, n), "/"))
    tried = asked.select("repo_key", "path", "imp_ord", F.posexplode(takes).alias("pos", "suffix")).join(owners, ["repo_key", "suffix"])
    longest = tried.groupBy("repo_key", "path", "imp_ord").agg(F.min(F.struct("pos", "suffix", "dir")).alias("b")).select("repo_key", "path", "imp_ord", F.col("b.suffix").alias("suffix"), F.col("b.dir").alias("dir"))
    inside = longest.join(dir_of.withColumnRenamed("path", "target"), ["repo_key", "dir"]).filter(F.col("target") != F.col("path"))
    stem = paths.stem(F.col("target"))
    rank = F.when(stem == F.element_at(F.split("suffix", "/"), -1), 0).when(stem.isin(*X.INDEX_FILES), 1)
    fourth = inside.withColumn("rank", rank).filter("rank IS NOT NULL").groupBy("repo_key", "path", "imp_ord").agg(F.min(F.struct("rank", "target")).alias("b")).select("repo_key", "path", "imp_ord", F.col("b.target").alias("target"), F.lit(4).alias("step"))

    every = first.unionByName(second).unionByName(third).unionByName(fourth)
    return every.groupBy("repo_key", "path", "imp_ord").agg(F.min(F.struct("step", "target")).alias("b")).select("repo_key", "path", "imp_ord", F.col("b.target").alias("target"), F.col("b.step").alias("step"))


def import_edges(resolved: DataFrame) -> DataFrame:
    """Distinct (repo_key, src, dst)."""
    return resolved.select("repo_key", F.col("path").alias("src"), F.col("target").alias("dst")).distinct()


def name_owners(definitions: DataFrame) -> DataFrame:
    """(repo_key, name, owner) once per file that defines the name."""
    return definitions.select("repo_key", "name", F.col("path").alias("owner")).distinct()


def unique_names(definitions: DataFrame) -> DataFrame:
    """(repo_key, name, owner) of the names that one file alone defines. A grouped minimum and maximum, no distinct."""
    g = definitions.groupBy("repo_key", "name").agg(F.min("path").alias("owner"), F.max("path").alias("last"))
    return g.filter(F.col("owner") == F.col("last")).drop("last")


def call_edges(calls: DataFrame, definitions: DataFrame, imported: DataFrame) -> DataFrame:
    """Distinct (repo_key, src, dst); a callee's name must have one defining file but the caller's own, or else
    one among those that the caller imports.

    Calls are reduced to distinct (file, name) before any join. The count of owners decides by itself where a name has
    at most two; for the others only the caller's imports are looked at, so a common name never meets all its owners.
    """
    asked = calls.select("repo_key", F.col("path").alias("src"), F.col("to_name").alias("name")).distinct()
    owners = name_owners(definitions)
    few = owners.groupBy("repo_key", "name").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("low"), F.max("owner").alias("high"))
    placed = asked.join(few, ["repo_key", "name"])
    other = F.when(F.col("low") == F.col("src"), F.col("high")).otherwise(F.col("low"))
    mine = (F.col("low") == F.col("src")) | (F.col("high") == F.col("src"))
    sole = placed.filter(((F.col("n") == 1) & ~mine) | ((F.col("n") == 2) & mine)).select("repo_key", "src", other.alias("dst"))
    rest = placed.filter(~(((F.col("n") == 1)) | ((F.col("n") == 2) & mine))).select("repo_key", "src", "name")
    via = rest.join(imported.select("repo_key", "src", F.col("dst").alias("owner")), ["repo_key", "src"]).join(owners, ["repo_key", "name", "owner"]).filter(F.col("owner") != F.col("src"))
    chosen = via.groupBy("repo_key", "src", "name").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("dst")).filter("n = 1")
    return sole.unionByName(chosen.select("repo_key", "src", "dst")).distinct()


def call_edges_of(nested, definitions: DataFrame, imported: DataFrame) -> DataFrame:  # noqa: ANN001
    """``call_edges`` from rows of files (``graphs.Nested``): only calls of names of at most two owners leave their file's row, as numbers, and what an imported file defines is looked up there.

    Where the count of owners decides, an import gives the same file, so neither has to leave out the other's names.
    """
    tables = Tables(definitions.sparkSession, "call_edges")
    owners = tables.write(name_owners(definitions).filter("repo_key IS NOT NULL AND name IS NOT NULL AND owner IS NOT NULL"))
    few = owners.groupBy("repo_key", "name").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("low"), F.max("owner").alias("high")).filter("n <= 2")
    few = dense_ids(few, "group", tables.write).withColumn("group", F.col("group").cast("int"))
    same = lambda files: files.withColumn("near", F.lit(None).cast("array<struct<name:string,owner:string,line:int>>"))
    asked = file_calls.asked_groups(nested(same), few).select("repo_key", F.col("path").alias("src"), F.explode("groups").alias("group"))
    placed = asked.join(few, ["repo_key", "group"])
    mine = (F.col("low") == F.col("src")) | (F.col("high") == F.col("src"))
    sole = placed.filter(((F.col("n") == 1) & ~mine) | ((F.col("n") == 2) & mine)).select("repo_key", "src", F.when(F.col("low") == F.col("src"), F.col("high")).otherwise(F.col("low")).alias("dst"))
    via = imported.select("repo_key", "src", F.col("dst").alias("owner")).distinct().filter(F.col("owner") != F.col("src")).join(owners, ["repo_key", "owner"])
    via = tables.write(via.groupBy("repo_key", F.col("src").alias("path"), "name").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("dst")).filter("n = 1").drop("n"))
    names = via.groupBy("repo_key", "path").agg(F.collect_list("name").alias("near"))
    called = F.flatten(F.transform("calls", lambda c: c["names"]))
    met = nested(lambda files: files.join(names, ["repo_key", "path"])).select("repo_key", "path", F.explode(F.array_intersect("near", called)).alias("name"))
    chosen = met.join(via, ["repo_key", "path", "name"]).select("repo_key", F.col("path").alias("src"), "dst")
    return sole.unionByName(chosen).distinct()


def merge_edges(imported: DataFrame, called: DataFrame) -> DataFrame:
    """(repo_key, src, dst, weight): 1 for an import edge plus 2 for a call edge."""
    w = lambda df, x: df.select("repo_key", "src", "dst", F.lit(x).alias("weight"))
    return w(imported, X.IMPORT_WEIGHT).unionByName(w(called, X.CALL_WEIGHT)).groupBy("repo_key", "src", "dst").agg(F.sum("weight").alias("weight"))


def rank_edges(imports: DataFrame, calls: DataFrame, definitions: DataFrame, files: DataFrame) -> DataFrame:
    """The ranking graph: 1 for each relative import that one of ten candidates meets, repeats counted, plus 2 for
    each file that defines a called name, once for each distinct name's files.

    Here a name's owners are all meant, so a name that very many files define and call has that many edges by definition.
    """
    i = relative_imports(imports, files, full=False).groupBy("repo_key", F.col("path").alias("src"), F.col("target").alias("dst")).agg((F.count(F.lit(1)) * F.lit(X.IMPORT_WEIGHT)).alias("weight"))
    asked = calls.select("repo_key", F.col("path").alias("src"), F.col("to_name").alias("name")).distinct()
    pairs = asked.join(name_owners(definitions), ["repo_key", "name"]).filter(F.col("owner") != F.col("src")).select("repo_key", "src", F.col("owner").alias("dst")).distinct()
    return i.unionByName(pairs.withColumn("weight", F.lit(X.CALL_WEIGHT))).groupBy("repo_key", "src", "dst").agg(F.sum("weight").alias("weight"))


def local_first(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """(repo_key, path, to_name, target, how): a call's own file if it defines the name, else the only file that does."""
    # all that is known of a name is dealt to it once: files are told apart there, and the only owner is looked up without another deal or a sort
    key = ["repo_key", "path", "to_name"]
    asked = calls.select(*key, F.lit(True).alias("asked"), F.lit(False).alias("own"))
    own = definitions.select("repo_key", "path", F.col("name").alias("to_name"), F.lit(False).alias("asked"), (F.col("repo_key").isNotNull() & F.col("path").isNotNull()).alias("own"))
    each = asked.unionByName(own).repartition("to_name").groupBy(*key).agg(F.max("asked").alias("asked"), F.max("own").alias("own")).filter("asked")
    sole = unique_names(definitions).withColumnRenamed("name", "to_name")
    mine = F.col("own") & F.col("to_name").isNotNull()
    both = each.join(sole.hint("shuffle_hash"), ["repo_key", "to_name"], "left")
    return both.select(*key, F.when(mine, F.col("path")).otherwise(F.col("owner")).alias("target"), F.when(mine, "local").when(F.col("owner").isNotNull(), "unique").otherwise("none").alias("how"))
