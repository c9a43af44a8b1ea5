"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` holds (measure, least, most) rows; ``MEASURES`` holds an expression for each measure over a few
raw counts of the text. ``assess`` compiles both into a single projection: no user functions, no shuffle,
one pass over each text, so the plan is a scan with one projection whatever the size of the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, let, quoted, words

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
#: Common function words of the corpus languages: English, German, French, Spanish.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "that", "is", "was", "for", "on", "with", "as", "it", "be", "by", "are", "at", "this", "from", "or", "an", "a", "have", "not", "you",
    "der", "die", "das", "und", "ist", "von", "den", "mit", "ein", "eine", "zu", "auf", "für", "nicht", "sich", "des", "im", "dem", "es", "sie",
    "le", "la", "les", "et", "un", "une", "du", "en", "est", "que", "qui", "dans", "pour", "par", "sur", "pas", "plus", "au", "il", "elle",
    "el", "los", "las", "y", "una", "del", "al", "por", "con", "para", "se", "no", "su", "lo", "como", "más",
)


@dataclass(frozen=True)
class Rule:
    """A text passes if its measure is null or within [least, most]; None leaves that end open."""

    measure: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("n_words", least=10),
    Rule("mean_word_chars", least=2, most=14),
    Rule("symbols_per_word", most=0.3),
    Rule("stop_word_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.5),
    Rule("mark_line_ratio", most=0.9),
    Rule("repeat_word_ratio", most=0.2),
)


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))


#: Measures over the raw counts; null where the denominator is 0.
MEASURES = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "mean_word_chars": lambda: _ratio("word_chars", "n_words"),
    "symbols_per_word": lambda: _ratio("n_symbols", "n_words"),
    "stop_word_ratio": lambda: _ratio("n_stop_words", "n_words"),
    "dup_line_ratio": lambda: _ratio("n_dup_lines", "n_lines"),
    "mark_line_ratio": lambda: _ratio("n_mark_lines", "n_lines"),
    "repeat_word_ratio": lambda: _ratio("n_repeat_words", "n_words"),
}


def _window(w: Column, i: Column, n: int) -> list[Column]:
    return [F.get(w, i + j) for j in range(n)]


def repeat_words(w: Column, n: int = WINDOW) -> Column:
    """How many of the words ``w`` lie in an ``n``-word window that the text holds twice or more.

    Texts whose window hashes all differ, nearly all, have none and are done after one hash set. Else the
    windows are sorted as strings with their positions; equal neighbours mark the repeated ones, and the
    union of the marked stretches is summed in order. n log n in the length of the text, with no pairs.
    """
    starts = F.sequence(F.lit(0), F.size(w) - n)

    def union_length(at: Column) -> Column:
        nxt = lambda i: F.coalesce(F.get(at, i + 1) - F.get(at, i), F.lit(n))
        return F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(n), nxt(i))), F.lit(0), lambda a, x: a + x)

    def marked(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["g"] == F.get(s, j)["g"], F.lit(False))
        kept = F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"]))
        return F.array_sort(F.filter(kept, lambda p: p.isNotNull()))

    def slow(w: Column) -> Column:
        grams = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, n), " ").alias("g"), i.alias("i")))
        return let(F.array_sort(grams), lambda s: let(marked(s), union_length))

    hashes = F.transform(starts, lambda i: F.xxhash64(*_window(w, i, n)))
    return F.when(F.size(w) <= n, F.lit(0)).otherwise(F.when(let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(slow(w)))


def counts(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The raw counts of every text beside the columns ``carry``.

    A null text has no words and no lines. Lines are split at line feeds and count if they have a word. Texts
    may be of any length: all of a text is counted. Repeated rows and ties need no care, as rows don't meet.
    """
    t = F.coalesce(F.col(quoted(text)), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•|]|(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_mark_lines"),
        )

    lined = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = [F.col(quoted(c)) for c in carry]
    w, lns = fresh(carry, "_w"), fresh(carry, "_l")
    return docs.select(*kept, let(words(t), of_words).alias(w), let(lined, of_lines).alias(lns), F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols")).select(
        *kept, f"{w}.*", f"{lns}.*", "n_symbols"
    )


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The names of the measures that a row fails, as one array expression."""
    failed = []
    for r in rules:
        value = MEASURES[r.measure]()
        out = F.lit(False)
        if r.least is not None:
            out = out | (value < r.least)
        if r.most is not None:
            out = out | (value > r.most)
        failed.append(F.when(F.coalesce(out, F.lit(False)), F.lit(r.measure)))
    return F.array_compact(F.array(*failed))


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of every text, ``failed`` (the measures out of bounds) and ``kept`` (none is)."""
    return counts(docs, text, carry).withColumn("failed", compile_rules(rules)).withColumn("kept", F.size("failed") == 0)
