"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

A candidate string is scored by the mean log-likelihood ratio of its character pairs under two first-order
Markov models, one of random strings and one of ordinary identifiers, both trained from labelled samples by
grouped counts. The models compile into one literal array of ratios, indexed by a pair of character codes, so
scanning is a projection without user functions or shuffles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, quoted

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]+)"
#: Cheap tests that a text may have a span of the kind that is long enough.
MAY_HAVE = {"hex": "[0-9a-f]{32}", "access": "AKIA[A-Z0-9]{12}", "markov": "[A-Za-z0-9+/_-]{20}"}


@dataclass(frozen=True)
class Kind:
    """``pattern`` with one group; a match counts if the group has ``least`` characters or more."""

    name: str
    pattern: str
    least: int


KINDS = (Kind("assign", ASSIGN, 8), Kind("access", ACCESS, 16), Kind("hex", HEX, 32))
#: Runs that the models judge.
CANDIDATE = r"([A-Za-z0-9+/_-]+)"
CANDIDATE_LEAST = 20
#: Runs of fewer different characters (rules of dashes, padding) are not keys.
LEAST_DIFFERENT = 8
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"

#: Parts of ordinary identifiers, for the default samples.
IDENTIFIER_PARTS = (
    "get", "set", "user", "name", "list", "index", "value", "count", "file", "path", "data", "table", "column", "schema", "parse", "build",
    "create", "update", "delete", "insert", "request", "response", "handler", "manager", "service", "client", "server", "config", "option",
    "default", "element", "object", "string", "number", "buffer", "stream", "reader", "writer", "connection", "message", "event", "listener",
    "session", "context", "result", "error", "status", "format", "version", "package", "module", "import", "export", "function", "method",
    "class", "interface", "abstract", "return", "order", "customer", "product", "account", "balance", "document", "section", "paragraph",
    "language", "translation", "dictionary", "international", "characteristic", "responsibility", "configuration", "implementation",
)
#: The default samples: so many strings of either label.
SAMPLES = 4000


def default_samples(spark: SparkSession, n: int = SAMPLES, seed: str = "sample") -> DataFrame:
    """(text, random): ``n`` labelled strings of either kind, the same for every ``seed`` each time.

    Random ones are in base 64, in letters alone, in capitals and digits, and in letters and digits. Ordinary ones are
    identifiers in five styles, dated paths, and UUIDs, which name things and open nothing. A bounded sample that does not
    depend on the documents; labelled strings of one's own do as well.
    """
    parts = F.array(*[F.lit(p) for p in IDENTIFIER_PARTS])
    base = spark.range(2 * n).withColumn("d", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    number = lambda at, size: F.conv(F.substring("d", at, size), 16, 10).cast("long")
    pick = lambda k: F.element_at(parts, (F.pmod(number(1 + 4 * k, 4), F.lit(len(IDENTIFIER_PARTS))) + 1).cast("int"))
    dated = F.concat_ws("/", pick(0), (F.lit(1990) + F.pmod(number(40, 4), F.lit(40))).cast("string"), F.lpad(F.pmod(number(44, 4), F.lit(12)).cast("string"), 2, "0"), F.concat_ws("-", pick(1), pick(2)))
    uuid = F.concat_ws("-", *[F.substring("d", at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    styles = (
        F.concat(pick(0), F.initcap(pick(1)), F.initcap(pick(2)), F.initcap(pick(3))), F.concat_ws("_", pick(0), pick(1), pick(2), pick(3)), F.concat_ws("-", pick(0), pick(1), pick(2), F.substring("d", 60, 1)),
        F.concat_ws("/", pick(0), pick(1), F.upper(pick(2)), pick(3)), F.upper(F.concat_ws("_", pick(0), pick(1), pick(2), pick(3))), F.concat(pick(0), pick(1), pick(2), pick(3)), dated, uuid,
    )
    key = F.base64(F.unhex("d"))
    noise = (F.translate(key, "=", ""), F.translate(key, "0123456789+/=", ""), F.upper(F.translate(key, "+/=", "")), F.translate(key, "+/=", ""))
    of = lambda kinds: F.element_at(F.array(*kinds), (F.pmod("id", F.lit(len(kinds))) + 1).cast("int"))
    return base.select(F.when(F.col("id") < n, of(noise)).otherwise(of(styles)).alias("text"), (F.col("id") < n).alias("random"))


@dataclass(frozen=True)
class Model:
    """``ratios``: log P(b|a) under random minus under ordinary, at code(a) * size + code(b); ``threshold``: of the mean."""

    ratios: tuple[float, ...]
    threshold: float


def train(samples: DataFrame, threshold: float = 0.9, alphabet: str = ALPHABET) -> Model:
    """Count the character pairs of labelled (text, random) samples, with add-half smoothing.

    The driver gets at most two counts for each pair of the alphabet. Null texts count for nothing; without
    samples every ratio is 0 and no string is found.
    """
    size = len(alphabet)
    chars = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z0-9+/_-]"), F.lit(0))
    pairs = samples.select("random", F.explode(let(chars, lambda c: F.when(F.size(c) > 1, F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.concat(F.get(c, i), F.get(c, i + 1)))))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for a in alphabet:
        rows = {label: sum(counts.get((label, a + b), 0) for b in alphabet) for label in (True, False)}
        for b in alphabet:
            p = {label: (counts.get((label, a + b), 0) + 0.5) / (rows[label] + 0.5 * size) for label in (True, False)}
            out.append(round(math.log(p[True] / p[False]), 4))
    return Model(tuple(out), threshold)


def _located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, group) in code points.

    The pieces between the matches give the places; matches aren't empty, so there is one piece more than matches.
    """

    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    pieces = F.split(text, pattern, -1)
    return F.arrays_zip(matched.alias("whole"), groups.alias("part"), pieces.alias("before"))


def _spans(text: Column, pattern: str, least: int) -> Column:
    """As ``_located``, of those whose group is long enough; the running place is kept in one aggregate."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.coalesce(F.length(x["whole"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), x["part"].alias("part"))
        long_enough = F.coalesce(F.length(x["part"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(long_enough, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,part:string>>").alias("spans"))
    return F.aggregate(_located(text, pattern), zero, step, lambda acc: acc["spans"])


def score(text: Column, model: Model, alphabet: str = ALPHABET) -> Column:
    """Mean log-likelihood ratio of the character pairs of a string over the alphabet; 0 for under two characters."""
    size, ratios = len(alphabet), F.array(*[F.lit(x) for x in model.ratios])

    def mean(codes: Column) -> Column:
        n = F.size(codes) - 1
        total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + F.get(ratios, F.get(codes, i) * size + F.get(codes, i + 1)))
        return F.when(n > 0, total / n).otherwise(F.lit(0.0))

    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.instr(F.lit(alphabet), F.substring(text, i, F.lit(1))) - 1)
    return F.when(F.length(text) > 1, let(codes, mean)).otherwise(F.lit(0.0))


def _typed(rank: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def scan(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",), name: str = "spans") -> DataFrame:
    """``spans`` of every text: array of (start, rank, end, kind) in code points, end exclusive, by start, then kind.

    Ranks: assign 0, access 1, hex 2, markov 3 (20 characters or more, ``LEAST_DIFFERENT`` of them different, that the
    models take for random). A null text is empty, an empty table gives an empty result, repeated rows are scanned each. Spans of different kinds may overlap; equal
    ones of one kind can't arise. Every text is searched whole; those that can't hold a kind skip it after one
    regular expression.
    """
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,part:string>>")
    typed = []
    for rank, k in enumerate(KINDS):
        found = F.when(t.rlike(MAY_HAVE.get(k.name, k.pattern)), _spans(t, k.pattern, k.least)).otherwise(none)
        typed.append(F.transform(found, _typed(rank, k.name)))
    cands = F.when(t.rlike(MAY_HAVE["markov"]), _spans(t, rf"([A-Za-z0-9+/_-]{{{CANDIDATE_LEAST},}})", CANDIDATE_LEAST)).otherwise(none)
    different = lambda part: F.size(F.array_distinct(F.split(part, ""))) >= LEAST_DIFFERENT
    random = F.filter(cands, lambda s: different(s["part"]) & (score(s["part"], model) > model.threshold))
    typed.append(F.transform(random, _typed(len(KINDS), "markov")))
    return docs.select(*[F.col(quoted(c)) for c in carry], F.array_sort(F.concat(*typed)).alias(name))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with ``mark`` in place of each stretch that spans cover; spans that overlap share a mark."""

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        kept = F.when(apart, F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.array_append(acc["parts"], kept).alias("parts"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    tail = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, tail)).otherwise(text)
