"""Benchmark decontamination by Wu-Manber search for many test strings at once.

The alphabet is the words of the benchmark (any other word is 0) and a block is two consecutive words. For test
strings of m words, a shift table holds for each block how far a window may move without missing one: ``m - 1`` for
a block that no string has. Where the shift is 0, the bucket of the block's hash names the strings that end so, and
each is compared word for word. Strings are grouped by length, since the least length bounds the shifts.

The search runs many text pieces in lockstep with numpy, each at its own place, so the shifts are really skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from .shared import Scratch, fresh, quoted

#: Words in a window; an item of fewer, but not none, is one window.
WINDOW = 10
#: Words of a text piece that is searched in lockstep with others.
PIECE = 256
#: Benchmark text that is searched for at once; a larger benchmark is split into shards of about this many bytes.
SHARD_BYTES = 16 << 20
#: Places compared at once.
COMPARED = 1 << 16

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def split_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8: ASCII digits, letters (A-Z lower-cased) and all beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


@dataclass
class Group:
    """Strings of one length ``m``: their words ``[n, m]``, the shift table, and the strings by suffix block."""

    strings: np.ndarray
    block: int = field(init=False)
    bits: int = field(init=False)
    shift: np.ndarray = field(init=False)
    suffixes: np.ndarray = field(init=False)
    starts: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n, m = self.strings.shape
        self.block = min(2, m)
        self.bits = int(min(22, max(10, np.ceil(np.log2(8 * n * m + 1)))))
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.int8 if m < 100 else np.int32)
        for end in range(self.block, m + 1):  # the last block position first counts least
            np.minimum.at(self.shift, self.hashes(self.strings[:, :end]), m - end)
        suffix = self.hashes(self.strings)
        order = np.argsort(suffix, kind="stable")
        self.strings = self.strings[order]
        self.suffixes, self.starts = np.unique(suffix[order], return_index=True)
        self.order = order

    def hashes(self, words: np.ndarray) -> np.ndarray:
        """Of the last block of each row."""
        return self.mix(words[:, -2] if self.block == 2 else 0, words[:, -1])

    def mix(self, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        x = (np.uint64(0x9E3779B97F4A7C15) * (np.asarray(b, np.uint64) + np.uint64(1))) ^ (np.uint64(0xC2B2AE3D27D4EB4F) * (np.asarray(a, np.uint64) + np.uint64(1)))
        return ((x * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def places(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Ends (inclusive) where the shift is 0, in texts that follow each other in ``words`` with the given bounds."""
        m = self.strings.shape[1]
        lengths = np.diff(bounds)
        pieces = np.maximum(0, -(-(lengths - m + 1) // PIECE))  # each piece owns PIECE starts
        text = np.repeat(np.arange(lengths.size), pieces)
        k = np.arange(text.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = bounds[text] + k * PIECE + m - 1
        stop = np.minimum(at + PIECE, bounds[text + 1])
        found = []
        while at.size:
            step = self.shift[self.mix(words[at - 1] if self.block == 2 else 0, words[at])]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def occurrences(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, string number) of every occurrence; numbers as given at first."""
        m, ends = self.strings.shape[1], self.places(words, bounds)
        if not ends.size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        h = self.mix(words[ends - 1] if self.block == 2 else 0, words[ends])
        b = np.minimum(np.searchsorted(self.suffixes, h), self.suffixes.size - 1)
        ends, b = ends[(ok := self.suffixes[b] == h)], b[ok]
        sizes = np.diff(np.append(self.starts, self.strings.shape[0]))[b]
        out_at, out_s = [], []
        upto = np.cumsum(sizes)
        lo = 0
        while lo < ends.size:  # so many places that their buckets have about COMPARED strings
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + COMPARED, "right")))
            n = sizes[lo:hi]
            start = np.repeat(ends[lo:hi] - m + 1, n)
            s = np.repeat(self.starts[b[lo:hi]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            for j in range(m):
                same = words[start + j] == self.strings[s, j]
                start, s = start[same], s[same]
            out_at.append(start)
            out_s.append(self.order[s])
            lo = hi
        return (np.concatenate(out_at), np.concatenate(out_s)) if out_at else (np.empty(0, np.int64), np.empty(0, np.int64))


class Matcher:
    """Searches the windows of (item id, text) pairs."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        for item, text in items:
            ws = [self.ids.setdefault(w, len(self.ids) + 1) for w in split_words(text)]
            m = min(window, len(ws))
            for i in range(len(ws) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(tuple(ws[i : i + m]), set()).add(number[item])
        self.groups = [(Group(np.array(list(s), np.int64)), [np.array(sorted(x)) for x in s.values()]) for _, s in sorted(by_length.items())]

    def search(self, words: list[list[bytes]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each text: starts and ends of the occurrences' stretches as one [n, 2] array, and numbers of the items."""
        get = self.ids.get
        bounds = np.cumsum([0, *map(len, words)])
        flat = np.fromiter((get(w, 0) for ws in words for w in ws), np.int64, int(bounds[-1]))
        spans, owners = [np.empty((0, 2), np.int64)], []
        for group, items in self.groups:
            at, s = group.occurrences(flat, bounds)
            if not at.size:
                continue
            spans.append(np.stack((at, at + group.strings.shape[1]), axis=1))
            pairs = np.unique(np.stack((np.searchsorted(bounds, at, "right") - 1, s), axis=1), axis=0)
            owners += [(int(t), int(k)) for t, x in pairs for k in items[x]]
        span = np.unique(np.concatenate(spans), axis=0)
        text = np.searchsorted(bounds, span[:, 0], "right") - 1
        cut = np.searchsorted(text, np.arange(len(words) + 1))
        of: list[set[int]] = [set() for _ in words]
        for t, k in owners:
            of[t].add(k)
        return [span[cut[t] : cut[t + 1]] - bounds[t] for t in range(len(words))], [np.array(sorted(x), np.int64) for x in of]


def load_shards(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The benchmark as shards of (item id as string, text), each of about ``shard_bytes`` at most.

    Its size is summed first; a shard is fetched when it is asked for, so one is on the driver at a time. Items with a
    null id count under the empty id; null texts have no windows and are left out.
    """
    rows = benchmark.filter(F.col(quoted(text)).isNotNull()).select(F.coalesce(F.col(quoted(item_id)).cast("string"), F.lit("")).alias("i"), F.col(quoted(text)).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    return ([(r["i"], r["t"]) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()] for k in range(n))


def _hits(docs: DataFrame, shard: list[tuple[str, str]], kept: list[str], text: str, window: int, whole: bool) -> DataFrame:
    """Columns ``kept``, and ``words``, ``spans`` (start, end, start, ...) and ``found`` of the texts that ``shard`` occurs in, or of all (``whole``)."""
    session = docs.sparkSession
    items = session.sparkContext.broadcast(shard)
    base = docs.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(text)).alias(fresh(kept, "_t")))
    names = [fresh(kept, c) for c in ("_words", "_spans", "_found")]
    schema = base.select(*[F.col(quoted(c)) for c in kept]).schema.add(names[0], "long").add(names[1], ArrayType(LongType())).add(names[2], ArrayType(StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items.value, window)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            n, spans, found = [], [], []
            for lo, hi in pieces(texts):
                words = [split_words(t) for t in texts[lo:hi]]
                n += map(len, words)
                s, i = matcher.search(words)
                spans += [x.ravel() for x in s]
                found += [[matcher.items[k] for k in x] for x in i]
            rows = pa.array(np.arange(len(texts)) if whole else np.array([k for k, x in enumerate(found) if x], np.int64))
            cols = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([c.take(rows) for c in (*b.columns[:-1], *cols)], names=[*b.schema.names[:-1], *names])

    return base.mapInArrow(run, schema)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), window: int = WINDOW, shard_bytes: int = SHARD_BYTES, names: tuple[str, str, str] = ("n_words", "n_hit", "items")) -> DataFrame:
    """``n_words``, ``n_hit`` and ``items`` (sorted ids as strings) of every text beside the columns ``carry``.

    ``names`` renames the three where ``carry`` has columns so called. A null or empty text, and an empty benchmark, give
    no hits; an empty table gives an empty result; repeated rows are searched each. Texts are searched whole; a text of
    any length is cut into pieces that overlap by a window.

    A benchmark of one shard is one pass without a shuffle. A larger one is searched for shard by shard: each shard's
    tables are built once a task, its hits are a table in the shared folder, and hits of all shards are put together by
    the text's row. On the driver, and broadcast, is one shard at a time, bounded by ``shard_bytes``.
    """
    shards = load_shards(benchmark, shard_bytes=shard_bytes)
    first, second = next(shards), next(shards, None)
    if second is None:
        out = _hits(docs, first, list(carry), text, window, whole=True)
        return _counted(out, carry, names)
    scratch, row = Scratch(docs.sparkSession, "decontaminate"), fresh([*carry, text], "_row")
    texts = scratch.table(docs.select(*{c: F.col(quoted(c)) for c in (*carry, text)}.values(), F.monotonically_increasing_id().alias(row)))
    found = None
    for shard in (s for part in ((first, second), shards) for s in part):
        hits = scratch.table(_hits(texts, shard, [row], text, window, whole=False))
        found = hits if found is None else found.union(hits)
    spans, items = fresh([row], "_spans"), fresh([row], "_found")
    merged = found.groupBy(row).agg(F.flatten(F.collect_list(spans)).alias(spans), F.flatten(F.collect_list(items)).alias(items))
    words = _hits(texts, [], [*carry, row], text, window, whole=True)
    w, s, i = (fresh([*carry, row], c) for c in ("_words", "_spans", "_found"))
    none = words.drop(s, i).join(merged.select(F.col(row), F.col(spans).alias(s), F.col(items).alias(i)), row, "left")
    return _counted(none.select(*[F.col(quoted(c)) for c in carry], w, s, i), carry, names)


def _counted(found: DataFrame, carry: tuple[str, ...], names: tuple[str, str, str]) -> DataFrame:
    """``n_words``, how many words the spans cover, and the items' ids, from the last three columns."""
    w, s, i = (F.col(quoted(c)) for c in found.columns[-3:])
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(s) - 2, F.lit(2)), lambda k: F.struct(F.get(s, k).alias("at"), F.get(s, k + 1).alias("to"))))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["to"]).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), x["to"] - F.greatest(x["at"], acc["end"]))).alias("n"))
    n_hit = F.when(F.coalesce(F.size(s), F.lit(0)) > 0, F.aggregate(pairs, zero, step, lambda acc: acc["n"])).otherwise(F.lit(0).cast("long"))
    ids = F.array_sort(F.array_distinct(F.coalesce(i, F.array().cast("array<string>"))))
    return found.select(*[F.col(quoted(c)) for c in carry], w.alias(names[0]), n_hit.alias(names[1]), ids.alias(names[2]))


def pieces(texts: list[str | None], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters together, or one text."""
    lo = n = 0
    for hi, t in enumerate(texts):
        if n and n + len(t or "") > most:
            yield lo, hi
            lo, n = hi, 0
        n += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)
