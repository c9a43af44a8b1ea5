"""Queries over the driver's tables, one per operator, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import fixed as X
from .functions import paths, text
from .operators.cycles import find_cycles
from .operators import graphs, metrics, modules, navigation, resolve, search, symbols
from .registry import query
from .sources import tables, tree
from .sources.tables import read
from .storage import Tables
from .streaming import session
from . import cache

FILES = "files AS (SELECT 'src/' || source || '/' || lang || '_' || doc_id || '.md' AS path, text, doc_id, lang, source FROM documents)"
LINES = FILES + ", lines AS (SELECT path, t[i] AS content, i AS line FROM (SELECT path, string_split(text, chr(10)) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM files))"
DEFS = LINES + """, defs AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY line) AS def_ord, lower(word) AS name, line,
 coalesce(lead(line) OVER (PARTITION BY path ORDER BY line) - 1, last) AS end_line, regexp_matches(word, '^[A-Z]') AS exported
 FROM (SELECT path, line, regexp_extract(content, '[A-Za-z]+') AS word, max(line) OVER (PARTITION BY path) AS last FROM lines) WHERE word <> '')"""
CALLS = DEFS + """, calls AS (SELECT path, from_name, lower(u) AS to_name, line, pos FROM (SELECT path, lower(regexp_extract(content, '[A-Za-z]+')) AS from_name, line,
 unnest(regexp_extract_all(content, '[A-Za-z]{4,}')) AS u, unnest(range(1, len(regexp_extract_all(content, '[A-Za-z]{4,}')) + 1)) AS pos FROM lines))"""
LIVE = CALLS + ", live AS (SELECT path, to_name AS name, line, pos AS col FROM calls WHERE pos = 1 OR (path, line, to_name) NOT IN (SELECT path, line, name FROM defs))"
IMPORTS = """n AS (SELECT count(*) AS n FROM documents), imports AS (
 SELECT path, 0 AS imp_ord, regexp_replace(path, '[^/]*$', '') || lang || '_' || ((doc_id * 7 + 1) % n) || '.md' AS target FROM files, n
 UNION ALL SELECT path, 1, 'src/' || source || '/' || lang || '_' || ((doc_id * 20) % n) || '.md' FROM files, n),
 imported AS (SELECT DISTINCT i.path AS src, f.path AS dst FROM imports i JOIN files f ON f.path = i.target WHERE f.path <> i.path)"""
UNIQUE = "uniq AS (SELECT name, min(path) AS owner FROM defs GROUP BY name HAVING count(DISTINCT path) = 1)"
CALL_EDGES = """asked AS (SELECT DISTINCT path AS src, to_name AS name FROM calls), owners AS (SELECT DISTINCT name, path AS owner FROM defs),
 other AS (SELECT a.src, a.name, o.owner, count(*) OVER (PARTITION BY a.src, a.name) AS n FROM asked a JOIN owners o ON a.name = o.name AND o.owner <> a.src),
 via AS (SELECT o.src, o.name, min(o.owner) AS dst FROM other o JOIN imported i ON i.src = o.src AND i.dst = o.owner WHERE o.n > 1 GROUP BY 1, 2 HAVING count(*) = 1),
 called AS (SELECT DISTINCT src, owner AS dst FROM other WHERE n = 1 UNION SELECT DISTINCT src, dst FROM via)"""
GRAPH = f"{CALLS}, {IMPORTS}, {CALL_EDGES}, edges AS (SELECT src, dst, sum(w)::DOUBLE AS weight FROM (SELECT src, dst, 1.0 AS w FROM imported UNION ALL SELECT src, dst, 2.0 FROM called) GROUP BY 1, 2)"
DEGREES = """deg AS (SELECT f.path, coalesce(i.n, 0)::BIGINT AS in_degree, coalesce(o.n, 0)::BIGINT AS out_degree FROM files f
 LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM edges WHERE src <> dst GROUP BY dst) i ON i.dst = f.path LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM edges WHERE src <> dst GROUP BY src) o ON o.src = f.path),
 roles AS (SELECT *, CASE WHEN in_degree = 0 AND out_degree > 0 THEN 'entry' WHEN in_degree >= 2 THEN 'core' WHEN out_degree = 0 AND in_degree > 0 THEN 'leaf' ELSE 'support' END AS role FROM deg)"""
MODULE = "(CASE WHEN NOT contains({0}, '/') THEN '(root)' WHEN len(string_split({0}, '/')) >= 3 AND lower(string_split({0}, '/')[1]) IN ('packages', 'libs', 'modules', 'apps', 'src') THEN string_split({0}, '/')[1] || '/' || string_split({0}, '/')[2] ELSE string_split({0}, '/')[1] END)"


def _sql_weight(t: str) -> str:
    n = lambda chars: f"len(regexp_extract_all({t}, '[{chars}]'))"
    alnum, space, cjk = n("0-9A-Za-z_"), n(r" \n\t\r"), n(X.CJK)
    return f"({alnum} * 0.25::DOUBLE + {space} * 0.26::DOUBLE + (length({t}) - {alnum} - {space} - {cjk}) * 0.62::DOUBLE + {cjk} * 1.02::DOUBLE)"


def out(df: DataFrame) -> DataFrame:
    """Without the adapter's only repository, and with counts as longs."""
    return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes if c != "repo_key"])


def _files(spark: SparkSession, d: str) -> DataFrame:
    return tables.files(read(spark, d, "documents"))


def _imports(spark: SparkSession, d: str) -> DataFrame:
    return tables.imports(_files(spark, d), read(spark, d, "documents").count())


def _imported(spark: SparkSession, d: str) -> DataFrame:
    return resolve.import_edges(resolve.relative_imports(_imports(spark, d), _files(spark, d)))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    f, imported = _files(spark, d), _imported(spark, d)
    return resolve.merge_edges(imported, resolve.call_edges(tables.calls(f), tables.definitions(f), imported))


@query(f"SELECT doc_id, ceil({_sql_weight('text')})::BIGINT AS tokens, ceil({_sql_weight('text')}) <= 0.95 * 1000 AS fits FROM documents")
def token_estimate(spark, d):
    """F1, F2."""
    t = text.estimate_tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", t.alias("tokens"), text.fits_budget(F.col("text"), 1000).alias("fits"))


@query(f"SELECT source, count(*)::BIGINT AS docs FROM (SELECT source, ceil(sum({_sql_weight('text')}) OVER (PARTITION BY source ORDER BY doc_id)) AS t FROM documents) WHERE t <= 0.95 * 32000 GROUP BY source")
def budget_fit(spark, d):
    """How many documents of each source, in order, fit a budget: one running sum prices every prefix."""
    w = Window.partitionBy("source").orderBy("doc_id")
    priced = read(spark, d, "documents").select("source", F.ceil(F.sum(text.token_weight(F.col("text"))).over(w)).alias("t"))
    return priced.filter(F.col("t") <= 0.95 * 32000).groupBy("source").agg(F.count(F.lit(1)).alias("docs"))


_FNV = "lpad(lower(hex(list_reduce([2166136261::BIGINT] || list_transform(regexp_extract_all({0}, '[\\s\\S]'), lambda c: ord(c)::BIGINT), lambda a, c: (xor(a, c) * 16777619) & 4294967295))), 8, '0')"


@query(f"SELECT doc_id, {_FNV.format('text')} AS content_hash FROM documents")
def content_hash(spark, d):
    """F3."""
    return read(spark, d, "documents").select("doc_id", text.fnv1a(F.col("text")).alias("content_hash"))


@query(f"SELECT {_FNV.format('text')} AS content_hash, count(*)::BIGINT AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def dup_content(spark, d):
    """F3, A22."""
    g = read(spark, d, "documents").groupBy("text").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")
    return g.select(text.fnv1a(F.col("text")).alias("content_hash"), "copies", "first_doc")


@query(
    f"WITH {FILES} SELECT path, len(t)::BIGINT AS total_lines, (len(list_filter(t, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '')) - c)::BIGINT AS sloc, c::BIGINT AS comment_lines FROM (SELECT path, t, len(list_filter(t, lambda x: regexp_matches(x, '^\\s*(#|//|/\\*|\\*|--)') AND trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '')) AS c FROM (SELECT path, string_split(text, chr(10)) AS t FROM files))"
)
def line_metrics(spark, d):
    """M3 from text."""
    return out(metrics.line_metrics(_files(spark, d)))


_PATTERN = "(the|und)[a-z]*er"


@query(f"WITH {LINES} SELECT path, line, substr(content, 1, 300) AS text, len(regexp_extract_all(content, '{_PATTERN}'))::BIGINT AS count FROM lines WHERE regexp_matches(content, '{_PATTERN}')")
def regex_search(spark, d):
    """F14."""
    return out(search.regex_lines(_files(spark, d), _PATTERN))


@query(f"WITH {LINES} SELECT coalesce(sum(len(regexp_extract_all(content, '{_PATTERN}'))), 0)::BIGINT AS matches, count(*)::BIGINT AS rows, count(DISTINCT path)::BIGINT AS files FROM lines WHERE regexp_matches(content, '{_PATTERN}')")
def search_totals(spark, d):
    """A16."""
    return out(search.search_totals(search.regex_lines(_files(spark, d), _PATTERN)))


@query(f"WITH {LINES} SELECT path, sum(len(regexp_extract_all(content, '{_PATTERN}')))::BIGINT AS matches, count(*)::BIGINT AS lines FROM lines WHERE regexp_matches(content, '{_PATTERN}') GROUP BY path")
def search_by_file(spark, d):
    """A17."""
    return out(search.by_file(search.regex_lines(_files(spark, d), _PATTERN)).withColumn("lines", F.size("lines")))


@query()
def search_capped(spark, d):
    """A report of the first rows."""
    return out(search.capped(search.regex_lines(_files(spark, d), _PATTERN)))


@query()
def fuzzy_rank(spark, d):
    """A top-50 report."""
    return search.fuzzy_rank(read(spark, d, "part").select("p_partkey", "p_name", "p_type"), "blu anv", F.col("p_name"), F.col("p_type"), order=F.col("p_partkey"))


@query(
    "SELECT doc_id, len(t)::BIGINT AS n_terms, array_to_string(list_sort(t), ' ') AS terms FROM (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9\\x{4E00}-\\x{9FFF}]+'), lambda w: lower(w)), lambda w: length(w) >= 2 AND w NOT IN ("
    + ", ".join(f"'{w}'" for w in X.FOCUS_STOP_WORDS)
    + "))) AS t FROM documents)"
)
def query_terms(spark, d):
    """F10."""
    t = text.query_terms(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_terms"), F.array_join(F.array_sort(t), " ").alias("terms"))


_FOCUS = "theAnd inaThe src3 where"
_TERMS = ("src3", "ina")


def _sql_best(low: str, path: bool) -> str:
    best = []
    for t in _TERMS:
        if path:
            best.append(f"CASE WHEN len(list_filter(string_split({low}, '/'), lambda s: s = '{t}' OR regexp_replace(s, '\\.[a-z0-9]+$', '') = '{t}')) > 0 THEN 5.0 WHEN contains({low}, '{t}') THEN 2.0 ELSE 0.0 END")
        else:
            best.append(f"CASE WHEN {low} = '{t}' THEN 6.0 WHEN starts_with({low}, '{t}') THEN 4.0 WHEN contains({low}, '{t}') THEN 2.5 ELSE 0.0 END")
    return f"greatest({', '.join(best)})::DOUBLE"


@query(f"WITH {DEFS} SELECT path, sum(s)::DOUBLE AS score FROM (SELECT path, {_sql_best('lower(path)', True)} AS s FROM files UNION ALL SELECT path, {_sql_best('name', False)} FROM defs) WHERE s > 0 GROUP BY path")
def focus_seeds(spark, d):
    """F11, R1."""
    f = _files(spark, d)
    return search.focus_seeds(f, tables.definitions(f), _FOCUS).select("path", "score")


@query(
    f"""WITH {GRAPH}, seeds AS (SELECT path, sum(s)::DOUBLE AS score FROM (SELECT path, {_sql_best('lower(path)', True)} AS s FROM files UNION ALL SELECT path, {_sql_best('name', False)} FROM defs) WHERE s > 0 GROUP BY path),
 nb AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) WHERE src <> dst),
 ord AS (SELECT s.path, s.score, CASE WHEN {_sql_best('lower(s.path)', True)} > 0 THEN 0 ELSE 1 END AS part FROM seeds s),
 h1 AS (SELECT n.dst AS path, arg_min(o.score, lpad(o.part::VARCHAR, 1, '0') || o.path) * 0.35::DOUBLE AS score, min(o.part::VARCHAR || o.path) AS k FROM nb n JOIN ord o ON n.src = o.path WHERE n.dst NOT IN (SELECT path FROM seeds) GROUP BY n.dst),
 h2 AS (SELECT n.dst AS path, arg_min(h.score, h.k || chr(1) || h.path) * {0.35**2!r}::DOUBLE AS score FROM nb n JOIN h1 h ON n.src = h.path WHERE n.dst NOT IN (SELECT path FROM seeds) AND n.dst NOT IN (SELECT path FROM h1) GROUP BY n.dst)
 SELECT path, round(score, 6) AS score, hop::BIGINT AS hop FROM (SELECT path, score, 0 AS hop FROM seeds UNION ALL SELECT path, score, 1 FROM h1 UNION ALL SELECT path, score, 2 FROM h2)"""
)
def focus_diffusion(spark, d):
    """G15."""
    f = _files(spark, d)
    spread = search.diffuse(search.focus_seeds(f, tables.definitions(f), _FOCUS), _edges(spark, d).drop("weight"))
    return out(spread.select("path", F.round("score", 6).alias("score"), "hop"))


@query()
def focus_top(spark, d):
    """A top-12 report."""
    f = _files(spark, d)
    return out(search.focus(f, tables.definitions(f), _edges(spark, d).drop("weight"), _FOCUS))


@query(f"WITH {LIVE} SELECT name, sum(d)::BIGINT AS n_definitions, sum(r)::BIGINT AS n_references, count(DISTINCT path)::BIGINT AS file_count FROM (SELECT path, name, 1 AS d, 0 AS r FROM defs UNION ALL SELECT path, name, 0, 1 FROM live) GROUP BY name")
def symbol_index(spark, d):
    """A1, J15."""
    f = _files(spark, d)
    return out(symbols.symbol_counts(tables.definitions(f), tables.references(f)))


@query(f"WITH {LIVE} SELECT (SELECT count(DISTINCT name) FROM (SELECT name FROM defs UNION ALL SELECT name FROM live))::BIGINT AS symbols, (SELECT count(*) FROM defs)::BIGINT AS definitions, (SELECT count(*) FROM live)::BIGINT AS \"references\", (SELECT count(*) FROM files)::BIGINT AS files")
def index_stats(spark, d):
    """A2."""
    f = _files(spark, d)
    return out(symbols.index_stats(tables.definitions(f), tables.references(f), f))


@query(
    f"""WITH {CALLS}, asked AS (SELECT DISTINCT path AS current_path, to_name AS name FROM calls),
 own AS (SELECT path AS current_path, name, min(line) AS line FROM defs GROUP BY 1, 2), anyd AS (SELECT name, path, line FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, line) AS k FROM defs) WHERE k = 1)
 SELECT a.name, a.current_path, CASE WHEN o.line IS NOT NULL THEN a.current_path ELSE g.path END AS path, coalesce(o.line, g.line)::BIGINT AS line FROM asked a JOIN anyd g ON a.name = g.name LEFT JOIN own o ON o.name = a.name AND o.current_path = a.current_path"""
)
def goto_definition(spark, d):
    """N2, for every file and name that it calls."""
    f = _files(spark, d)
    asked = tables.calls(f).select("repo_key", F.col("to_name").alias("name"), F.col("path").alias("current_path"))
    return out(symbols.goto_definition(asked, tables.definitions(f)))


@query(f"WITH {LIVE} SELECT path, line, col FROM live WHERE name = 'that'")
def find_references(spark, d):
    """N3."""
    f = _files(spark, d)
    return out(symbols.find_references(tables.references(f), tables.definitions(f), "that"))


@query(f"WITH {LIVE} SELECT name, sum(d)::BIGINT AS n_definitions, sum(r)::BIGINT AS n_references, count(DISTINCT path)::BIGINT AS file_count FROM (SELECT path, name, 1 AS d, 0 AS r FROM defs UNION ALL SELECT path, name, 0, 1 FROM live) WHERE starts_with(name, 'th') GROUP BY name ORDER BY n_references DESC, name LIMIT 20")
def suggest_symbols(spark, d):
    """N4, T9."""
    f = _files(spark, d)
    return out(symbols.suggest_symbols(symbols.symbol_counts(tables.definitions(f), tables.references(f)), "Th"))


@query(f"WITH {DEFS}, {UNIQUE} SELECT name, owner FROM uniq")
def unique_names(spark, d):
    """J3."""
    return out(resolve.unique_names(tables.definitions(_files(spark, d))))


@query(f"WITH {CALLS}, {IMPORTS}, {CALL_EDGES} SELECT src, dst FROM called")
def call_edges(spark, d):
    """G5, J3, J4."""
    f = _files(spark, d)
    return out(resolve.call_edges(tables.calls(f), tables.definitions(f), _imported(spark, d)))


@query(
    f"WITH {CALLS}, {UNIQUE}, own AS (SELECT DISTINCT path, name FROM defs) SELECT a.path, a.to_name, CASE WHEN o.name IS NOT NULL THEN a.path ELSE u.owner END AS target, CASE WHEN o.name IS NOT NULL THEN 'local' WHEN u.owner IS NOT NULL THEN 'unique' ELSE 'none' END AS how FROM (SELECT DISTINCT path, to_name FROM calls) a LEFT JOIN own o ON o.path = a.path AND o.name = a.to_name LEFT JOIN uniq u ON u.name = a.to_name"
)
def local_first_calls(spark, d):
    """J2."""
    f = _files(spark, d)
    return out(resolve.local_first(tables.calls(f), tables.definitions(f)))


@query(f"WITH {GRAPH} SELECT src, dst, weight FROM edges")
def weighted_edges(spark, d):
    """A5, G2, U1."""
    return out(_edges(spark, d))


@query(f"WITH {FILES}, {IMPORTS} SELECT i.path, i.imp_ord::BIGINT AS imp_ord, i.target FROM imports i JOIN files f ON f.path = i.target WHERE i.target <> i.path")
def relative_import(spark, d):
    """J7."""
    return out(resolve.relative_imports(_imports(spark, d), _files(spark, d)))


@query(f"WITH {FILES}, {IMPORTS} SELECT i.path, i.imp_ord::BIGINT AS imp_ord, i.target, 1::BIGINT AS step FROM imports i JOIN files f ON f.path = i.target WHERE i.target <> i.path")
def import_resolver(spark, d):
    """G4."""
    return out(resolve.resolve_imports(_imports(spark, d), _files(spark, d)))


@query(f"WITH {GRAPH}, {DEGREES} SELECT path, in_degree, out_degree, role FROM roles")
def role_classify(spark, d):
    """A4, G9."""
    return out(graphs.neighbour_degrees(_files(spark, d), _edges(spark, d)))


@query(
    f"WITH {GRAPH}, {DEGREES} SELECT path, row_number() OVER (ORDER BY list_position(['entry', 'core', 'support', 'leaf'], role), CASE role WHEN 'entry' THEN -out_degree WHEN 'core' THEN -in_degree ELSE 0 END, in_degree DESC, path)::BIGINT AS \"order\", role, 0.0::DOUBLE AS score, in_degree, out_degree FROM roles"
)
def reading_order(spark, d):
    """G10, W1, with degrees alone."""
    return out(graphs.reading_order(_files(spark, d), _edges(spark, d)))


@query()
def reading_path(spark, d):
    """With ranks, to six digits."""
    f, e = _files(spark, d), _edges(spark, d)
    ranks = graphs.pagerank(f.select("repo_key", F.col("path").alias("id")), e)
    return out(graphs.reading_order(f, e, ranks.withColumn("rank", F.round("rank", 6))))


@query(
    f"WITH {GRAPH}, {DEGREES}, o AS (SELECT path, row_number() OVER (ORDER BY list_position(['entry', 'core', 'support', 'leaf'], role), CASE role WHEN 'entry' THEN -out_degree WHEN 'core' THEN -in_degree ELSE 0 END, in_degree DESC, path)::BIGINT AS k FROM roles) SELECT string_split(path, '/')[1] AS dir, min(k) AS first_order, count(*)::BIGINT AS files FROM o GROUP BY 1"
)
def reading_groups(spark, d):
    """W2."""
    return out(graphs.reading_groups(graphs.reading_order(_files(spark, d), _edges(spark, d))))


NATIONS = """trade AS (SELECT s.s_nationkey AS src, c.c_nationkey AS dst, sum(l_quantity)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey GROUP BY 1, 2),
 top AS (SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, w FROM trade)"""


def _nations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations, and from each supplier nation all customer nations that buy from it."""
    t = lambda n: read(spark, d, n)
    # the dimensions join before the facts, and lines are summed by order and supplier nation only once they are narrow
    j = t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src")), "l_suppkey")
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(t("customer").select("c_custkey", F.col("c_nationkey").alias("dst")), "c_custkey")
    trade = j.join(o, "l_orderkey").groupBy("src", "dst").agg(F.sum("l_quantity").alias("weight"))
    repo = F.lit("nations").alias("repo_key")
    return t("nation").select(repo, F.col("n_nationkey").cast("string").alias("id")), trade.select(repo, F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight")


_PR_ROUNDS = 20


@query(
    f"""WITH RECURSIVE {NATIONS}, e AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM top WHERE src <> dst),
 nodes AS (SELECT n_nationkey::VARCHAR AS id, (SELECT count(*) FROM nation)::DOUBLE AS n FROM nation),
 m AS (SELECT a.id AS src, b.id AS dst, 0.15::DOUBLE / a.n + 0.85::DOUBLE * coalesce(e.share, CASE WHEN a.id IN (SELECT src FROM e) THEN 0 ELSE 1 / a.n END) AS p FROM nodes a CROSS JOIN nodes b LEFT JOIN e ON e.src = a.id AND e.dst = b.id),
 r(k, ranks) AS (SELECT 0, (SELECT map(list(id ORDER BY id), list(1 / n ORDER BY id)) FROM nodes) UNION ALL SELECT k + 1, (SELECT map(list(dst ORDER BY dst), list(s ORDER BY dst)) FROM (SELECT m.dst, sum(m.p * r.ranks[m.src]) AS s FROM m GROUP BY m.dst)) FROM r WHERE k < {_PR_ROUNDS})
 SELECT id, round(ranks[id], 6) AS rank FROM r, nodes WHERE k = {_PR_ROUNDS}"""
)
def pagerank_nations(spark, d):
    """G8, so many rounds."""
    nodes, edges = _nations(spark, d)
    return out(graphs.pagerank(nodes, edges, rounds=_PR_ROUNDS, tolerance=0.0)).withColumn("rank", F.round("rank", 6))


_SYMBOL_ROUNDS = 12


@query(
    f"""WITH RECURSIVE {LIVE}, {IMPORTS}, num AS (SELECT path, row_number() OVER (ORDER BY path) AS i, (SELECT count(*) FROM files)::DOUBLE AS n FROM files),
 pairs AS (SELECT DISTINCT c.path AS src, x.path AS dst FROM (SELECT DISTINCT path, to_name FROM calls) c JOIN (SELECT DISTINCT path, name FROM defs) x ON x.name = c.to_name AND x.path <> c.path),
 w AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 2.0::DOUBLE AS w FROM pairs UNION ALL SELECT i.path, f.path, count(*)::DOUBLE FROM imports i JOIN files f ON f.path = i.target WHERE f.path <> i.path GROUP BY 1, 2) GROUP BY 1, 2),
 e AS (SELECT a.i AS src, b.i AS dst, w / sum(w) OVER (PARTITION BY src) AS share FROM w JOIN num a ON a.path = src JOIN num b ON b.path = dst),
 r(k, ranks) AS (SELECT 0, (SELECT list(1 / n ORDER BY i) FROM num) UNION ALL
  SELECT k + 1, (SELECT list(0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + lost / n) ORDER BY num.i)
   FROM num LEFT JOIN (SELECT dst, sum(share * r.ranks[src]) AS got FROM e GROUP BY dst) g ON g.dst = num.i, (SELECT coalesce(sum(r.ranks[i]), 0) AS lost FROM num WHERE i NOT IN (SELECT src FROM e)) l) FROM r WHERE k < {_SYMBOL_ROUNDS}),
 f AS (SELECT path, round(ranks[i] / list_sum(ranks), 9) AS score FROM r, num WHERE k = {_SYMBOL_ROUNDS}),
 c AS (SELECT name, count(*) AS refs FROM live GROUP BY name)
 SELECT path, def_ord::BIGINT AS def_ord, x.name, line::BIGINT AS line, score, coalesce(refs, 0)::BIGINT AS refs, row_number() OVER (ORDER BY score DESC, coalesce(refs, 0) DESC, path, line, def_ord)::BIGINT AS rank FROM defs x JOIN f USING (path) LEFT JOIN c ON c.name = x.name"""
)
def symbol_ranks(spark, d):
    """So many rounds, scores to nine digits."""
    f = _files(spark, d)
    defs = tables.definitions(f).select("repo_key", "path", "def_ord", "name", "line")
    ranks = graphs.file_ranks(_imports(spark, d), tables.calls(f), defs, f, rounds=_SYMBOL_ROUNDS, tolerance=0.0, nested=lambda met: tables.nested(f, met)).withColumn("rank", F.round("rank", 9))
    return out(graphs.rank_symbols(defs, tables.live_counts(f), ranks).select("repo_key", "path", "def_ord", "name", "line", "score", "refs", "rank"))


@query(
    f"WITH RECURSIVE {NATIONS}, reach AS (SELECT src, dst FROM top UNION SELECT r.src, t.dst FROM reach r JOIN top t ON r.dst = t.src) SELECT a.src AS id, min(a.dst) AS scc FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src"
)
def scc_members(spark, d):
    """G11 membership."""
    _, edges = _nations(spark, d)
    return out(graphs.strong_components(edges))


#: A depth-first search as a recursion over one row: what was met, the path to where it stands, and a step to the first neighbour not met, or back.
_SEARCH = """adj AS (SELECT map(list(src), list(next)) AS m FROM (SELECT src, list(dst ORDER BY dst) AS next FROM e GROUP BY src)),
 ids AS (SELECT list(id ORDER BY id) AS all_ids FROM (SELECT DISTINCT unnest([src, dst]) AS id FROM e)),
 walk(seen, path) AS (SELECT []::VARCHAR[], []::VARCHAR[] UNION ALL SELECT CASE WHEN nxt IS NULL THEN seen ELSE list_append(seen, nxt) END, CASE WHEN nxt IS NULL THEN path[:-2] ELSE list_append(path, nxt) END
   FROM (SELECT seen, path, list_filter(CASE WHEN len(path) = 0 THEN all_ids ELSE m[path[-1]] END, lambda x: NOT list_contains(seen, x))[1] AS nxt, all_ids FROM walk, adj, ids) WHERE len(path) > 0 OR len(seen) < len(all_ids)),
 met AS (SELECT unnest(seen) AS id, unnest(range(1, len(seen) + 1)) AS pos FROM (SELECT seen FROM walk ORDER BY len(seen) DESC LIMIT 1)),
 reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src),
 scc AS (SELECT DISTINCT a.src AS id, min(a.dst) OVER (PARTITION BY a.src) AS scc FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src),
 turned AS (SELECT scc, id, pos, pos < min(CASE WHEN id = scc THEN pos END) OVER (PARTITION BY scc) AS before FROM scc JOIN met USING (id))
 SELECT string_agg(id, ' ' ORDER BY before, pos) AS cycle, count(*)::BIGINT AS n FROM turned GROUP BY scc"""


def _cycles(edges: DataFrame) -> DataFrame:
    return find_cycles(edges).select(F.array_join("cycle", " ").alias("cycle"), F.size("cycle").cast("long").alias("n"))


@query(f"WITH RECURSIVE {NATIONS}, e AS (SELECT src, dst FROM top), {_SEARCH}")
def cycles(spark, d):
    """G11 with the order of members."""
    _, edges = _nations(spark, d)
    return _cycles(edges)


@query(f"WITH RECURSIVE {NATIONS}, e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS k FROM top) WHERE k <= 2), {_SEARCH}")
def trade_cycles(spark, d):
    """G11 with the order of members, each nation with its two best customers."""
    _, edges = _nations(spark, d)
    best = Window.partitionBy("repo_key", "src").orderBy(F.desc("weight"), "dst")
    return _cycles(edges.withColumn("k", F.row_number().over(best)).filter("k <= 2"))


@query(
    f"""WITH {DEFS}, {IMPORTS}, calls AS (SELECT path, lower(regexp_extract(content, '[A-Za-z]+')) AS from_name, lower(unnest(regexp_extract_all(content, '[A-Za-z]{{4,}}'))) AS to_name FROM lines),
 of AS (SELECT path, name, arg_max(line, def_ord) AS last_line, min(line) AS first_line FROM defs GROUP BY 1, 2), g AS (SELECT name, count(*) AS n, min(path) AS only_path, arg_min(first_line, path) AS only_line FROM of GROUP BY 1),
 a AS (SELECT DISTINCT c.path, c.path || '#' || c.from_name || '@' || o.last_line AS src, c.to_name AS name FROM calls c JOIN of o ON o.path = c.path AND o.name = c.from_name),
 p AS (SELECT a.*, l.last_line AS local_line, g.n, g.only_path, g.only_line FROM a LEFT JOIN of l ON l.path = a.path AND l.name = a.name LEFT JOIN g ON g.name = a.name),
 v AS (SELECT p.src, p.name, min(o.path || '#' || p.name || '@' || o.first_line) AS dst FROM p JOIN imported i ON i.src = p.path JOIN of o ON o.path = i.dst AND o.name = p.name WHERE p.local_line IS NULL AND p.n > 1 GROUP BY 1, 2 HAVING count(*) = 1)
 SELECT DISTINCT src, dst FROM (SELECT src, CASE WHEN local_line IS NOT NULL THEN path || '#' || name || '@' || local_line ELSE only_path || '#' || name || '@' || only_line END AS dst FROM p WHERE local_line IS NOT NULL OR n = 1 UNION ALL SELECT src, dst FROM v) WHERE src <> dst"""
)
def function_calls(spark, d):
    """G6 edges."""
    f = _files(spark, d)
    return out(graphs.call_graph(tables.definitions(f), tables.calls(f), _imported(spark, d), lambda met: tables.nested(f, met))[1])


@query()
def top_k_graph(spark, d):
    """A top-120 report."""
    f = _files(spark, d)
    nodes, edges = graphs.call_graph(tables.definitions(f), tables.calls(f), _imported(spark, d), lambda met: tables.nested(f, met))
    return out(graphs.top_graph(nodes, edges)[0])


def _sql_purpose(name: str) -> str:
    return "CASE " + " ".join(f"WHEN lower({name}) IN ({', '.join(repr(n) for n in names)}) THEN '{key}'" for key, names in X.PURPOSES.items()) + " END"


@query(f"WITH {FILES}, m AS (SELECT {MODULE.format('path')} AS module FROM files) SELECT module, count(*)::BIGINT AS files, coalesce({_sql_purpose('''string_split(module, '/')[-1]''')}, {_sql_purpose('module')}, 'unknown') AS purpose, (CASE WHEN module = '(root)' THEN 0 ELSE len(string_split(module, '/')) END)::BIGINT AS depth FROM m GROUP BY module")
def module_rollup(spark, d):
    """G12, G13, A7."""
    return out(modules.modules(_files(spark, d)))


@query(f"WITH {GRAPH}, m AS (SELECT {MODULE.format('src')} AS src, {MODULE.format('dst')} AS dst FROM edges) SELECT src, dst, count(*)::BIGINT AS weight FROM m WHERE src <> dst GROUP BY 1, 2")
def module_edges(spark, d):
    """A7."""
    return out(modules.module_edges(_edges(spark, d)))


@query(f"WITH {FILES}, m AS (SELECT {MODULE.format('path')} AS module, count(*) AS n FROM files GROUP BY 1), p AS (SELECT module, n, coalesce({_sql_purpose('''string_split(module, '/')[-1]''')}, {_sql_purpose('module')}, 'unknown') AS purpose FROM m) SELECT purpose, string_agg(module, ',' ORDER BY module) AS dirs, sum(n)::BIGINT AS files FROM p GROUP BY purpose")
def layer_groups(spark, d):
    """A8."""
    return out(modules.layers(modules.modules(_files(spark, d))).withColumn("dirs", F.array_join("dirs", ",")))


def _classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as classes in a file per brand; a part's type's last word is what it extends, its brand what it implements."""
    p = read(spark, d, "part")
    path = F.concat(F.lit("parts/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(".ts"))
    name = F.element_at(F.split("p_name", " "), 1)
    repo = F.lit("parts").alias("repo_key")
    defs = p.select(repo, path.alias("path"), F.col("p_partkey").alias("def_ord"), name.alias("name"), F.lit("class").alias("kind"), F.col("p_partkey").alias("line"))
    rel = p.select(repo, path.alias("path"), F.col("p_partkey").alias("rel_ord"), name.alias("name"), F.array(F.element_at(F.split("p_name", " "), -1)).alias("extends"), F.array(F.concat(F.lit("I<"), "p_brand", F.lit(">"))).alias("implements"), F.col("p_partkey").alias("line"))
    return defs, rel


@query(
    """WITH p AS (SELECT 'parts/' || replace(p_brand, '#', '_') || '.ts' AS path, string_split(p_name, ' ')[1] AS name, string_split(p_name, ' ')[-1] AS ext FROM part),
 c AS (SELECT DISTINCT path, name, path || '#' || name AS id FROM p), s AS (SELECT DISTINCT path, name, ext AS "to", 'extends' AS kind FROM p UNION ALL SELECT DISTINCT path, name, 'I', 'implements' FROM p),
 g AS (SELECT name, count(*) AS n, min(id) AS only_id FROM c GROUP BY name),
 e AS (SELECT s.path || '#' || s.name AS src, CASE WHEN o.id IS NOT NULL THEN o.id WHEN g.n = 1 THEN g.only_id WHEN g.n IS NULL THEN 'ext:' || s."to" END AS dst, s.kind FROM s LEFT JOIN c o ON o.path = s.path AND o.name = s."to" LEFT JOIN g ON g.name = s."to")
 SELECT DISTINCT src, dst, kind FROM e WHERE dst IS NOT NULL AND src <> dst"""
)
def class_graph(spark, d):
    """G14, J14, F16."""
    return out(modules.class_graph(*_classes(spark, d))[1])


URLS = "u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"


def _urls(spark: SparkSession, d: str) -> DataFrame:
    p = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return read(spark, d, "pages").select(F.lit("pages").alias("repo_key"), "page_id", tree.clean_path(p).alias("path"), F.lit("file").alias("type"), F.length("html").cast("long").alias("size"))


@query(
    f"""WITH {URLS}, f AS (SELECT DISTINCT regexp_replace(regexp_replace(path, '^(\\./|/)+', ''), '/+$', '') AS path FROM u), s AS (SELECT path, string_split(path, '/') AS t FROM f WHERE path <> ''),
 dirs AS (SELECT DISTINCT array_to_string(t[1:i], '/') AS path FROM (SELECT t, unnest(range(1, len(t))) AS i FROM s)), every AS (SELECT path, 'dir' AS type FROM dirs UNION ALL SELECT path, 'file' FROM s)
 SELECT path, array_to_string(string_split(path, '/')[1:len(string_split(path, '/')) - 1], '/') AS parent, string_split(path, '/')[-1] AS name, len(string_split(path, '/'))::BIGINT AS depth, type FROM every"""
)
def url_tree(spark, d):
    """S14."""
    return out(tree.build_tree(_urls(spark, d)).drop("size"))


@query(
    r"WITH p AS (SELECT doc_id, string_split(source || '/./' || lang || '/../x' || (doc_id % 7) || '//y', '/') AS t, source, lang FROM documents) SELECT doc_id, source || '/x' || (doc_id % 7) || '/y' AS path FROM p"
)
def path_normalise(spark, d):
    """F5."""
    raw = F.concat("source", F.lit("/./"), "lang", F.lit("/../x"), F.pmod("doc_id", F.lit(7)).cast("string"), F.lit("//y"))
    return read(spark, d, "documents").select("doc_id", paths.normalize(raw).alias("path"))


@query("SELECT p_partkey, replace(p_brand, '#', '') AS type_name FROM part")
def type_name_norm(spark, d):
    """F16."""
    raw = F.concat(F.lit("public a.b::"), F.col("p_brand"), F.lit("<T>[]"))
    return read(spark, d, "part").select("p_partkey", text.type_name(raw).alias("type_name"))


@query(
    f"WITH {DEFS}, n AS (SELECT f.path, count(x.line) AS symbols FROM files f LEFT JOIN defs x ON x.path = f.path GROUP BY f.path), e AS (SELECT symbols, unnest(['', 'src', array_to_string(string_split(path, '/')[1:2], '/')]) AS dir FROM n) SELECT dir, count(*)::BIGINT AS files, sum(symbols)::BIGINT AS symbols FROM e GROUP BY dir"
)
def dir_digest(spark, d):
    """A13, J9."""
    f = _files(spark, d)
    return out(navigation.directory_stats(f, tables.definitions(f)))


@query()
def dir_digest_text(spark, d):
    """R2."""
    f = _files(spark, d)
    dirs = f.select("repo_key", paths.dirname(F.col("path")).alias("dir")).distinct()
    return out(navigation.digests(dirs, f, tables.definitions(f)))


@query(f"WITH {FILES} SELECT DISTINCT 'src' AS dir, 'source' AS purpose, 'rule' AS confidence FROM files UNION ALL SELECT DISTINCT 'src/' || source, 'docs', 'heuristic' FROM files")
def dir_purpose(spark, d):
    """A14, F18-F20."""
    return out(modules.directory_purposes(_files(spark, d)))


@query(
    f"""WITH {DEFS}, a AS (SELECT {MODULE.format('path')} || '/' AS address, name, path, line FROM defs), n AS (SELECT address, count(*)::BIGINT AS symbols FROM a GROUP BY 1),
 b AS (SELECT address, name, min(rank) AS rank FROM (SELECT address, name, row_number() OVER (ORDER BY path, line) AS rank FROM a) GROUP BY 1, 2),
 t AS (SELECT address, string_agg(name, ',' ORDER BY k) AS names FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY rank, name) AS k FROM b) WHERE k <= 3 GROUP BY 1)
 SELECT n.address, n.symbols, t.names, row_number() OVER (ORDER BY n.symbols DESC, n.address)::BIGINT AS "order" FROM n JOIN t USING (address)"""
)
def module_map(spark, d):
    """R4, A15, W4."""
    f = _files(spark, d)
    defs = tables.definitions(f)
    ranked = defs.withColumn("rank", F.struct("path", "line"))
    return out(navigation.module_map(f, defs, ranked).withColumn("names", F.array_join("names", ",")))


@query(f"WITH {DEFS} SELECT path, name, line, row_number() OVER (PARTITION BY path ORDER BY line)::BIGINT AS turn FROM defs")
def interleaved_index(spark, d):
    """W3."""
    f = _files(spark, d)
    order = f.select("repo_key", "path", F.col("doc_id").alias("file_rank"))
    return out(symbols.interleave(tables.definitions(f), order).select("path", "name", "line", "turn"))


ENCLOSING = f"WITH {DEFS}, q AS (SELECT path, line AS at FROM lines) SELECT q.path, q.at, x.name, x.line AS start, x.end_line AS \"end\" FROM q LEFT JOIN defs x ON x.path = q.path AND q.at BETWEEN x.line AND x.end_line"


@query(ENCLOSING)
def enclosing_symbol(spark, d):
    """Of every line."""
    f = _files(spark, d)
    return out(symbols.enclosing(tables.lines(f).select("repo_key", "path", F.col("line").alias("at")), tables.definitions(f)))


@query(ENCLOSING)
def enclosing_symbol_lines(spark, d):
    """Of every line, under its earlier name."""
    return enclosing_symbol(spark, d)


NESTED = LINES + """, word AS (SELECT path, line, regexp_extract(content, '[A-Za-z]+') AS word, max(line) OVER (PARTITION BY path) AS last FROM lines),
 lev AS (SELECT *, length(word) % 3 AS level FROM word WHERE word <> ''),
 nested AS (SELECT path, row_number() OVER o AS def_ord, lower(word) AS name, ['class', 'function', 'variable'][level + 1] AS kind, line,
 coalesce(CASE level WHEN 0 THEN min(CASE WHEN level = 0 THEN line END) OVER f WHEN 1 THEN min(CASE WHEN level <= 1 THEN line END) OVER f ELSE min(line) OVER f END - 1, last) AS end_line, regexp_matches(word, '^[A-Z]') AS exported
 FROM lev WINDOW o AS (PARTITION BY path ORDER BY line), f AS (PARTITION BY path ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


def _sql_outline(defs: str, name: str) -> str:
    return f"""WITH RECURSIVE {defs}, n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, end_line DESC, name, def_ord) AS node FROM {name}),
 up AS (SELECT x.path, x.node, max(p.node) AS last FROM n x JOIN n p ON p.path = x.path AND p.node < x.node AND p.kind <> 'variable' AND p.end_line >= x.line GROUP BY 1, 2),
 own AS (SELECT x.*, CASE WHEN p.end_line >= x.end_line THEN p.node END AS parent FROM n x LEFT JOIN up u ON u.path = x.path AND u.node = x.node LEFT JOIN n p ON p.path = x.path AND p.node = u.last),
 deep AS (SELECT path, node, 0 AS depth FROM own WHERE parent IS NULL UNION ALL SELECT o.path, o.node, d.depth + 1 FROM own o JOIN deep d ON d.path = o.path AND d.node = o.parent)
 SELECT o.path, o.node::BIGINT AS node, o.parent::BIGINT AS parent, d.depth::BIGINT AS depth, o.name, o.kind, o.line::BIGINT AS line, o.end_line::BIGINT AS end_line, o.exported FROM own o JOIN deep d USING (path, node)"""


@query(
    f"WITH {NESTED}, q AS (SELECT path, line AS \"at\" FROM lines), h AS (SELECT q.path, q.\"at\", x.name, x.line AS start, x.end_line AS \"end\", row_number() OVER (PARTITION BY q.path, q.\"at\" ORDER BY x.end_line - x.line, x.def_ord) AS k FROM q LEFT JOIN nested x ON x.path = q.path AND q.\"at\" BETWEEN x.line AND x.end_line) SELECT path, \"at\", name, start, \"end\" FROM h WHERE k = 1"
)
def enclosing_nested(spark, d):
    """Of every line, among definitions within definitions."""
    f = _files(spark, d)
    return out(symbols.enclosing(tables.lines(f).select("repo_key", "path", F.col("line").alias("at")), tables.nested_definitions(f)))


@query(
    f"WITH {FILES}, q AS (SELECT lang || '_' || doc_id || '.md' AS input FROM documents UNION ALL SELECT DISTINCT source || '/' || lang || '_1.md' FROM documents) SELECT q.input, min(f.path) AS path FROM (SELECT DISTINCT input FROM q) q JOIN files f ON f.path = q.input OR ends_with(f.path, '/' || q.input) GROUP BY q.input"
)
def suffix_match(spark, d):
    """J8."""
    docs = read(spark, d, "documents")
    q = docs.select(F.lit(tables.REPO).alias("repo_key"), F.concat("lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("input"))
    q = q.union(docs.select(F.lit(tables.REPO), F.concat("source", F.lit("/"), "lang", F.lit("_1.md"))))
    return out(navigation.match_paths(q, _files(spark, d)).select("input", "path"))


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    a = tables.definitions(f).groupBy("repo_key", "path").agg(F.max("line").alias("line"), F.max_by("name", "line").alias("name"))
    each = F.array(F.concat("path", F.lit(":"), F.col("line").cast("string")), F.concat("path", F.lit("#"), "name"), F.concat(F.lit("index:"), "path"), F.concat(paths.dirname(F.col("path")), F.lit("/")), F.col("path"), F.col("name"), F.concat("path", F.lit(":0")))
    return a.select("repo_key", F.explode(each).alias("address")).distinct()


@query()
def resolve_address(spark, d):
    """Seven addresses for every file."""
    f = _files(spark, d)
    return out(navigation.resolve_addresses(_addresses(spark, d), f, tables.definitions(f)))


@query()
def slice_text(spark, d):
    """R6, R7."""
    f = _files(spark, d)
    return out(navigation.slices(navigation.resolve_addresses(_addresses(spark, d), f, tables.definitions(f)), f))


@query(_sql_outline(DEFS.replace("SELECT path, row_number()", "SELECT path, 'function' AS kind, row_number()"), "defs"))
def outline_tree(spark, d):
    """N5, J11."""
    return out(symbols.outline(tables.definitions(_files(spark, d))))


@query(_sql_outline(NESTED, "nested"))
def outline_nested(spark, d):
    """Definitions within definitions."""
    return out(symbols.outline(tables.nested_definitions(_files(spark, d))))


FUNCTIONS = "fn AS (SELECT l_orderkey, count(*)::BIGINT AS cyclomatic, sum(l_quantity)::BIGINT // 5 AS cognitive, 10 * count(*)::BIGINT AS sloc FROM lineitem GROUP BY l_orderkey)"


def _functions(spark: SparkSession, d: str) -> DataFrame:
    """An order is a function, each of its lines a decision; its file is that of its key's hundred."""
    g = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("cyclomatic"), F.floor(F.sum("l_quantity") / 5).cast("long").alias("cognitive"))
    return g.select(F.lit("orders").alias("repo_key"), F.concat(F.lit("f"), F.pmod("l_orderkey", F.lit(100)).cast("string")).alias("path"), F.col("l_orderkey").alias("fn_ord"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("name"), "cyclomatic", "cognitive", (F.col("cyclomatic") * 10).alias("sloc"))


@query(
    f"WITH {FUNCTIONS} SELECT 'f' || (l_orderkey % 100) AS path, l_orderkey AS fn_ord, 'o' || l_orderkey AS name, cyclomatic, cognitive, sloc, rank FROM (SELECT *, row_number() OVER (ORDER BY cyclomatic DESC, cognitive DESC, 'f' || (l_orderkey % 100), l_orderkey) AS rank FROM fn) WHERE rank <= 50"
)
def top_functions(spark, d):
    """T5."""
    return out(metrics.top_functions(_functions(spark, d)))


@query(f"WITH {FUNCTIONS} SELECT 'f' || (l_orderkey % 100) AS path, sum(cyclomatic)::BIGINT AS cyclomatic, sum(cognitive)::BIGINT AS cognitive, max(cyclomatic)::BIGINT AS max_function_complexity FROM fn GROUP BY 1")
def file_complexity(spark, d):
    """M4."""
    return out(metrics.file_totals(_functions(spark, d)))


@query(
    f"""WITH {FUNCTIONS}, a AS (SELECT count(*)::BIGINT AS functions, avg(cyclomatic) AS cyc, avg(cognitive) AS cog, count(*) FILTER (cyclomatic > 15) AS hc, count(*) FILTER (cognitive > 25) AS hg, sum(sloc)::BIGINT AS sloc FROM fn)
 SELECT functions, floor(cyc * 100 + 0.5) / 100 AS avg_cyclomatic, floor(cog * 100 + 0.5) / 100 AS avg_cognitive, (hc + hg)::BIGINT AS high_complexity, sloc, greatest(0, floor(100 - (3 * hc + 2 * hg + 2 * greatest(0.0, cyc - 5) + 5) + 0.5))::BIGINT AS score FROM a"""
)
def health_score(spark, d):
    """M6, A11."""
    f = _functions(spark, d)
    files = f.groupBy("repo_key", "path").agg(F.sum("sloc").alias("sloc"), F.sum(F.lit(0)).alias("comment_lines"))
    return out(metrics.health(f, files))


@query(f"WITH {LINES} SELECT f.lang AS language, count(*)::BIGINT AS files, sum(n)::BIGINT AS sloc FROM files f JOIN (SELECT path, count(*) FILTER (trim(regexp_replace(content, '\\s+', ' ', 'g')) <> '') AS n FROM lines GROUP BY path) USING (path) GROUP BY f.lang")
def language_mix(spark, d):
    """A9, A10."""
    f = _files(spark, d)
    m = metrics.line_metrics(f, comment=r"^\b$").join(f.select("repo_key", "path", F.col("lang").alias("language")), ["repo_key", "path"])
    return out(metrics.language_mix(m))


@query(
    f"""WITH {FILES}, s AS (SELECT path, 100 - 4 * (len(string_split(path, '/')) - 1) + 30 AS score FROM files) SELECT path, score::BIGINT AS score, (SELECT count(*) FROM s)::BIGINT AS total FROM (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS k FROM s) WHERE k <= 500"""
)
def target_selection(spark, d):
    """T7, F21."""
    return out(search.select_targets(_files(spark, d), cap=500))


@query("WITH f AS (SELECT doc_id, doc_id % 3 = 0 AS changed FROM documents) SELECT count(*)::BIGINT AS files, count(*) FILTER (NOT changed)::BIGINT AS cached, count(*) FILTER (changed)::BIGINT AS parsed, 0::BIGINT AS failed FROM f")
def cache_hit_miss(spark, d):
    """A third of the files were changed since."""
    f = tables.files(read(spark, d, "documents"), hashed=True)
    old = f.withColumn("content_hash", F.when(F.col("doc_id") % 3 == 0, F.lit("changed")).otherwise(F.col("content_hash"))).withColumn("format_version", F.lit(1))
    return out(cache.counters(cache.split_by_cache(f, old)))


SLICES = f"s AS (SELECT conv_id::VARCHAR AS session, 'f' || (turn % 5) || ':' || turn AS address, ceil({_sql_weight('text')})::BIGINT AS tokens, turn AS round, turn % 3 AS hits, turn AS ord, 'f' || (turn % 5) AS file FROM conversations)"
_EVICT = "t AS (SELECT *, ord = max(ord) OVER (PARTITION BY session) AS newest, sum(tokens) OVER (PARTITION BY session) AS total FROM s), p AS (SELECT *, (NOT newest AND total - coalesce(sum(tokens) OVER (PARTITION BY session, newest ORDER BY hits * 1000 + round, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 150) AS dropped FROM t)"


def _slices(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    file = F.concat(F.lit("f"), F.pmod("turn", F.lit(5)).cast("string"))
    return c.select(F.col("conv_id").cast("string").alias("session"), F.concat(file, F.lit(":"), F.col("turn").cast("string")).alias("address"), text.estimate_tokens(F.col("text")).alias("tokens"), F.lit(None).cast("long").alias("file_tokens"), F.col("turn").alias("round"), F.pmod("turn", F.lit(3)).alias("hits"), F.col("turn").alias("ord"))


@query(f"WITH {SLICES}, {_EVICT} SELECT session, address, tokens, round, hits, dropped FROM p")
def session_eviction(spark, d):
    """Z5, W7."""
    return out(session.eviction(_slices(spark, d), 150).select("session", "address", "tokens", "round", "hits", "dropped"))


@query(
    f"""WITH {SLICES}, {_EVICT}, c AS (SELECT session, sum(cost) AS naive FROM (SELECT session, file, max(tokens * 4) AS cost FROM p GROUP BY 1, 2) GROUP BY 1),
 k AS (SELECT session, count(*)::BIGINT AS slices, count(*) FILTER (NOT dropped)::BIGINT AS kept, count(*) FILTER (dropped)::BIGINT AS dropped, coalesce(sum(tokens) FILTER (NOT dropped), 0)::BIGINT AS kept_tokens, coalesce(sum(tokens) FILTER (dropped), 0)::BIGINT AS dropped_tokens FROM p GROUP BY 1)
 SELECT session, slices, kept, dropped, kept_tokens, dropped_tokens, kept_tokens + 100 AS tokens, naive::BIGINT AS naive_tokens, CASE WHEN naive > 0 THEN floor(naive / (kept_tokens + 100) * 10 + 0.5) / 10 ELSE 0.0 END AS ratio FROM k JOIN c USING (session)"""
)
def session_ledger(spark, d):
    """A18, A19, Z6."""
    return out(session.ledger(session.eviction(_slices(spark, d), 150), pack_tokens=100))


def _repository(spark: SparkSession, d: str):
    """Documents as a repository, with all their calls; a document is a function of as many decisions as lines."""
    from .plans.pack import Repository

    f = _files(spark, d)
    lines = metrics.line_metrics(f)
    fn = lines.select("repo_key", "path", F.lit(1).alias("fn_ord"), F.lit("document").alias("name"), F.col("total_lines").alias("cyclomatic"), F.col("sloc").alias("cognitive"), "sloc")
    fm = lines.join(f.select("repo_key", "path", F.col("lang").alias("language")), ["repo_key", "path"]).withColumn("cyclomatic", F.col("total_lines")).withColumn("max_function_complexity", F.col("total_lines"))
    return Repository("documents", f, tables.definitions(f), tables.calls(f), _imports(spark, d), fn, fm, lambda met: tables.nested(f, met))


@query()
def context_pack(spark, d):
    """An overview."""
    from .plans.pack import pack_row

    return pack_row(_repository(spark, d), intent="overview", budget=8000)


@query()
def html_report(spark, d):
    """K5-K8."""
    from .plans.report import render_html, report_model

    r, imported = _repository(spark, d), Tables(spark, "imports").write(_imported(spark, d))
    nodes, calls = graphs.call_graph(r.definitions, r.calls, imported, r.nested)
    page = render_html(report_model(r, imported, nodes, calls))
    return spark.createDataFrame([("documents", page)], "name string, html string")


@query()
def class_diagram(spark, d):
    """K9, K10."""
    from .plans import diagrams

    nodes, edges, _ = modules.class_graph(*_classes(spark, d))
    return out(diagrams.class_diagram(*modules.top_classes(nodes, edges)))


@query("SELECT conv_id::VARCHAR AS session, coalesce(string_agg(text || chr(10), '' ORDER BY turn), '') AS text, string_agg('f' || turn || ':1', ' ' ORDER BY turn) AS addresses FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def marker_filter(spark, d):
    """Z2, over conversations as sessions of chunks."""
    from .streaming import markers

    c = read(spark, d, "conversations").filter("text IS NOT NULL").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), F.concat("text", F.lit("\n@@expand f"), F.col("turn").cast("string"), F.lit(":1\n")).alias("chunk"))
    return markers.filter_transcripts(c).withColumn("addresses", F.array_join("addresses", " "))


_ASKED = """a AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY turn) - 1 AS n, ['f' || (length(t) % 3) || ':1', 'f' || (length(t) % 7) || ':1'] AS m
   FROM (SELECT conv_id::VARCHAR AS session, turn, coalesce(min(text), '') AS t FROM conversations GROUP BY ALL)),
 w AS (SELECT session, n, m, []::VARCHAR[] AS asked FROM a WHERE n = 0
   UNION ALL SELECT a.session, a.n, a.m, list_append(w.asked, list_filter(w.m, lambda x: NOT list_contains(w.asked, x))[1]) FROM w JOIN a ON a.session = w.session AND a.n = w.n + 1
   WHERE w.n < 3 AND len(list_filter(w.m, lambda x: NOT list_contains(w.asked, x))) > 0),
 s AS (SELECT 'f' || (doc_id % 6) || ':1' AS address, doc_id % 6 <> 4 AS ok, min(length(text)) AS tokens, sum(length(text)) AS file_tokens FROM documents GROUP BY ALL),
 e AS (SELECT session, n, 'hit' AS event, unnest(list_filter(m, lambda x: list_contains(asked, x))) AS address FROM w
   UNION ALL SELECT session, n, CASE WHEN fresh IS NULL OR n >= 3 THEN 'end' ELSE 'slice' END, CASE WHEN n < 3 THEN fresh END FROM (SELECT *, list_filter(m, lambda x: NOT list_contains(asked, x))[1] AS fresh FROM w)),
 ev AS (SELECT session, n::INTEGER AS round, event, address, CASE WHEN event = 'slice' THEN coalesce(ok, false) END AS ok, CASE WHEN event = 'slice' THEN CASE WHEN ok THEN tokens ELSE 0 END END::BIGINT AS tokens,
   CASE WHEN event = 'slice' AND ok THEN file_tokens END::BIGINT AS file_tokens, CASE WHEN event = 'slice' AND NOT coalesce(ok, false) THEN CASE WHEN ok IS NULL THEN 'not-found' ELSE 'ambiguous' END END AS reason FROM e LEFT JOIN s USING (address))"""


def _expansions(spark: SparkSession, d: str) -> DataFrame:
    """Turns as answers with two markers and a line that is none; slices are summed up from documents."""
    from .streaming import expansion

    size = F.length("text")
    turns = read(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq")).agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    asks = lambda n: F.concat(F.lit("f"), F.pmod(size, F.lit(n)).cast("string"), F.lit(":1"))
    answers = turns.withColumn("text", F.concat("text", F.lit("\n@@expand "), asks(3), F.lit("\n@@expand no address\n  `@@expand "), asks(7), F.lit("`")))
    of = F.pmod("doc_id", F.lit(6))
    slices = read(spark, d, "documents").groupBy(of.alias("k")).agg(F.min(size).alias("tokens"), F.sum(size).alias("file_tokens"))
    slices = slices.select(F.concat(F.lit("f"), F.col("k").cast("string"), F.lit(":1")).alias("address"), F.when(F.col("k") == 4, "ambiguous").otherwise("ok").alias("kind"), "tokens", "file_tokens", F.lit(None).cast("string").alias("reason"))
    return expansion.expand(answers, slices)


@query(f"WITH RECURSIVE {_ASKED} SELECT * FROM ev")
def expansion_events(spark, d):
    """Z4, over conversations as sessions of answers."""
    return _expansions(spark, d)


@query(f"WITH RECURSIVE {_ASKED} SELECT session, f.address, round, ok, tokens, (SELECT count(*) FROM ev h WHERE h.session IS NOT DISTINCT FROM f.session AND h.event = 'hit' AND h.address = f.address)::BIGINT AS hits FROM ev f WHERE event = 'slice'")
def expansion_slices(spark, d):
    """What each session fetched, and how often it came back to it."""
    from .streaming.expansion import slices_of

    return slices_of(_expansions(spark, d)).select("session", "address", "round", "ok", "tokens", "hits")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """An extension: tumbling windows."""
    from .streaming.incremental import event_windows as windows

    return windows(read(spark, d, "events")).withColumn("total", F.round("total", 4))
