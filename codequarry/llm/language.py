"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent character n-grams in order. A document's own list is held
against each profile: an n-gram costs the distance between its two ranks, and the list's length if the profile
lacks it. The language with the least sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, quoted

#: Lengths of n-grams; a word is padded by one blank on either side.
ORDERS = (1, 2, 3)
#: N-grams in a profile and in a document's list.
PROFILE = 300
#: Documents of each language that the profiles are made from: those with the least hash.
SAMPLE_PER_LANGUAGE = 500


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """The n-grams of a lower-cased text as sorted int64, 21 bits a character; runs of non-letters are one blank (0)."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.concatenate(([0], np.where(letter, codes, 0), [0]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    one = codes[codes != 0]
    two = codes[:-1] << 21 | codes[1:]
    inner = codes[1:-1] != 0  # a trigram's middle is a letter
    three = (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[inner]
    out = np.concatenate((one, two, three))
    out.sort()
    return out


def counted(sorted_grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.concatenate(([True], sorted_grams[1:] != sorted_grams[:-1])))
    return sorted_grams[edges], np.diff(np.append(edges, sorted_grams.size))


def ranked(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by n-gram."""
    return values[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """``languages`` in order; ``known``: sorted n-grams of any profile; ``ranks``: of each by language, ``size`` if absent."""

    languages: tuple[str, ...]
    known: np.ndarray
    ranks: np.ndarray
    size: int

    @staticmethod
    def of(lists: dict[str, list[int]], size: int = PROFILE) -> Profiles:
        languages = tuple(sorted(lists))
        known = np.array(sorted({g for x in lists.values() for g in x}), np.int64)
        ranks = np.full((len(languages), known.size), size, np.int32)
        for k, name in enumerate(languages):
            own = np.array(lists[name], np.int64)
            ranks[k, np.searchsorted(known, own)] = np.arange(own.size)
        return Profiles(languages, known, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, ties by name, and one minus its distance over the largest; ``und`` and 0 without letters."""
        g = grams(text) if text else np.empty(0, np.int64)
        if not g.size or not self.languages:
            return "und", 0.0
        mine = ranked(*counted(g), self.size)
        at = np.minimum(np.searchsorted(self.known, mine), self.known.size - 1)
        theirs = np.where(self.known[at] == mine, self.ranks[:, at], self.size)
        away = np.where(theirs == self.size, self.size, np.abs(theirs - np.arange(mine.size)))
        sums = away.sum(axis=1)
        best = int(sums.argmin())
        return self.languages[best], round(1.0 - float(sums[best]) / (self.size * mine.size), 6)


def sample(docs: DataFrame, lang: str, order: Column, per_language: int) -> DataFrame:
    """At most ``per_language`` rows of each non-null language (repeated rows apart): those first in ``order``, a long.

    The place in ``order`` where each language's sample ends is found first, over two narrow columns and with the
    limit applied within each task before the shuffle, and is one long per language for the driver; the texts are
    then filtered by it as they are read, and don't move.
    """
    keys = docs.filter(F.col(quoted(lang)).isNotNull()).select(F.col(quoted(lang)).alias("lang"), order.alias("at"))
    first = Window.partitionBy("lang").orderBy("at")
    ends = keys.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_language).groupBy("lang").agg(F.max("at").alias("at")).collect()
    inside = F.lit(False)
    for r in ends:
        inside = inside | ((F.col(quoted(lang)) == r["lang"]) & (order <= r["at"]))
    return docs.filter(inside)


def fit(train: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, size: int = PROFILE) -> Profiles:
    """Profiles from a bounded sample of labelled rows: ``per_language`` texts of each language, those with the least hash.

    Rows with a null language or text are not learned from. N-grams are counted in the workers, summed by
    (language, n-gram), and the ``size`` most frequent of each language reach the driver.
    """
    picked = train.filter(F.col(quoted(text)).isNotNull()).select(F.col(quoted(lang)).cast("string").alias("lang"), F.col(quoted(text)).alias("text"), F.xxhash64(F.col(quoted(doc_id)).cast("string"), F.col(quoted(text))).alias("at"))
    picked = sample(picked, "lang", F.col("at"), per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = (c.to_pylist() for c in b.columns)
            for name in sorted(set(langs)):
                parts = [grams(t) for n, t in zip(langs, texts, strict=True) if n == name]
                values, counts = counted(np.sort(np.concatenate(parts))) if sum(p.size for p in parts) else (parts[0], parts[0])
                yield pa.RecordBatch.from_arrays([pa.array([name] * values.size, pa.string()), pa.array(values, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    counts = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size).collect()
    lists: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        lists.setdefault(r["lang"], []).append(r["gram"])
    return Profiles.of(lists, size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", carry: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The language and score of every whole text beside the columns ``carry``.

    ``und`` and 0 for a null text, one without letters, or without profiles. Texts are judged each on its own.
    """
    hidden = fresh(carry, "_t")
    base = docs.select(*[F.col(quoted(c)) for c in carry], F.col(quoted(text)).alias(hidden))
    schema = base.drop(hidden).schema.add(names[0], "string").add(names[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [profiles.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            cols = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*b.schema.names[:-1], *names])

    return base.mapInArrow(run, schema)
