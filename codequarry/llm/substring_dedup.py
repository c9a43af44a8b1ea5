"""Substring deduplication by MinHash banding of paragraphs.

Two kinds of paragraph are taken from every text, all of it:

* lines of ``LINE_WORDS`` words or more;
* windows of ``WINDOW_WORDS`` words from starts that the words themselves choose (in every ``GAP`` consecutive starts,
  that of the least 3-word shingle), so that a passage has the same windows wherever it stands, within lines or across
  them. A shared passage of ``GAP + WINDOW_WORDS - 1`` = 51 words holds a whole window at least. A text that is shorter
  than a window is one paragraph as it is.

Paragraphs get a MinHash of their 5-word shingles, cut into bands (at a similarity of 0.8, one pair in twenty shares no
band; at 0.9, one in 140; equal ones share all). Paragraphs that collide in a band are verified by exact Jaccard
similarity, word for word, and clustered by components. In each class the first occurrence, by doc_id and place, stays
and the others are marked as removals. Windows of one document that follow the same first occurrence are one passage,
which is carried on word by word to the true ends of the match.

Scale: a batch's paragraphs with the same band send one narrow row to the shuffle, the bands' groups are found by one
sort, and only paragraphs that share a band are looked at again; see ``linking`` for the pairs. Equal paragraphs are one
node, so a passage however common is verified once. Texts are read once for their paragraphs, and those of documents that
share something for the words that are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructType

from .decontaminate import pieces, split_words
from .hashing import hashed_words, kmers, mixed
from .linking import Rule, combined, link_classes, shared_buckets
from .shared import Scratch, quoted, row_key

LINE_WORDS, WINDOW_WORDS, GAP, SHINGLE, SIMILARITY = 20, 20, 32, 5, 0.8
BANDS, ROWS = 3, 2
#: Words that a passage may have before its first whole window or after its last one.
REACH = GAP
#: Characters whose paragraphs are made together.
TOGETHER = 1 << 19

_ODD = (np.random.default_rng(20240502).integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1)) | np.uint64(1)


def band_keys(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The keys of the bands ``[n, BANDS]`` of the paragraphs that ``starts`` and ``sizes`` (1 word at least) cut from ``words``."""
    grams = kmers(words, SHINGLE) if words.size >= SHINGLE else np.empty(0, np.uint64)
    short = np.flatnonzero(sizes < SHINGLE)
    at, to = starts.copy(), starts + sizes - SHINGLE + 1
    at[short] = grams.size + np.arange(short.size)
    to[short] = at[short] + 1
    grams = np.concatenate([grams, *(kmers(words[starts[i] : starts[i] + sizes[i]], SHINGLE) for i in short), np.zeros(1, np.uint64)])
    ranges = np.stack((at, to), axis=1).ravel()
    out = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], starts.size, axis=0)
    for k in range(BANDS * ROWS if starts.size else 0):
        h = grams * _ODD[k]
        h ^= h >> np.uint64(29)
        out[:, k // ROWS] = mixed(out[:, k // ROWS] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h, ranges)[::2])
    return out.view(np.int64)


def shingles(words: bytes) -> frozenset[tuple[bytes, ...]]:
    """The 5-word shingles of a paragraph, given as words and blanks."""
    w = words.split()
    return frozenset(tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1)))


def jaccard(a: frozenset, b: frozenset) -> float:
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def rule(least: float = SIMILARITY) -> Rule:
    """Exact similarity of the shingles, word for word."""
    features = lambda items: [np.fromiter(map(hash, x), np.int64, len(x)) for x in items]
    return Rule(lambda a, b: jaccard(a, b) >= least, features, lambda common, a, b: common >= least * (a + b - common) - 1e-6, shingles, 0.0)


def window_starts(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ascending starts, in ``words``, of the windows of texts of more than ``WINDOW_WORDS`` words that follow each other."""
    fits = np.maximum(0, np.diff(bounds) - WINDOW_WORDS + 1)
    fits[np.diff(bounds) <= WINDOW_WORDS] = 0
    if not fits.any():
        return np.empty(0, np.int64)
    h = kmers(words, 3)
    mask = np.uint64((1 << int(h.size).bit_length()) - 1)
    h = (h & ~mask) | np.arange(h.size, dtype=np.uint64)  # the least tells where it stands
    few = np.flatnonzero((fits > 0) & (fits < GAP))
    own = np.minimum.reduceat(h, np.stack((bounds[few], bounds[few] + fits[few]), axis=1).ravel())[::2] if few.size else h[:0]
    least, width = h, 1
    while width < GAP:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = np.maximum(0, fits - GAP + 1)
    at = np.repeat(bounds[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.unique(np.concatenate((own, least[at])) & mask).astype(np.int64)


def _stretches(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, their bounds, and of the paragraphs: text, start in ``words``, size, whether a line."""
    cut = [(t or "").split("\n") for t in texts]
    words, ends = hashed_words([x for c in cut for x in c])
    n_lines = np.array([len(c) for c in cut])
    bounds = ends[np.concatenate(([0], np.cumsum(n_lines)))]
    size, n = np.diff(ends), np.diff(bounds)
    lines = np.flatnonzero(size >= LINE_WORDS)
    short = np.flatnonzero((n > 0) & (n <= WINDOW_WORDS))
    at = window_starts(words, bounds)
    starts = np.concatenate((ends[lines], bounds[short], at))
    sizes = np.concatenate((size[lines], n[short], np.full(at.size, WINDOW_WORDS)))
    is_line = np.arange(starts.size) < lines.size
    text = np.searchsorted(bounds, starts, "right") - 1
    order = np.lexsort((starts, text))
    return words, bounds, text[order], starts[order], sizes[order], is_line[order]


_PLACE = StructType().add("bucket", LongType()).add("i", IntegerType())
_LOCAL = StructType().add("bucket", LongType()).add("i", IntegerType()).add("leader", LongType()).add("leader_i", IntegerType())


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, doc_id, key, starts, sizes, lines, nodes, own, local) of every row; paragraph ``i`` is the i-th of each list.

    ``nodes``: 16 bytes of digest for each paragraph. ``own`` has the bands that one row of a batch has, and the
    paragraphs that stand for theirs; ``local`` those that several rows have, with the paragraph that stands for them.
    """
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(quoted(doc_id)).cast("long").alias("doc_id"), row_key(F.col(quoted(doc_id)), F.col(quoted(text))).alias("key"), F.col(quoted(text)).alias("t"))
    schema = base.drop("t").schema.add("starts", ArrayType(IntegerType())).add("sizes", ArrayType(IntegerType())).add("lines", ArrayType(BooleanType())).add("nodes", BinaryType()).add("own", ArrayType(_PLACE)).add("local", ArrayType(_LOCAL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rids = batch.column(3).to_pylist(), batch.column(0).to_numpy()
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            nodes: list[bytes] = []
            for lo, hi in pieces(texts, TOGETHER):
                words, bounds, of, starts, sizes, is_line = _stretches(texts[lo:hi])
                nodes += [blake2b(words[s:e], digest_size=16).digest() for s, e in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)]
                for x, values in zip(parts, (of + lo, starts - bounds[of], sizes, is_line, band_keys(words, starts, sizes)), strict=True):
                    x.append(values)
            of, starts, sizes, is_line, keys = (np.concatenate(x) for x in parts)
            rows = np.searchsorted(of, np.arange(len(texts) + 1))
            i = np.arange(of.size) - rows[:-1][of]
            keys, owners = keys.ravel(), np.repeat(np.arange(of.size), BANDS)
            first, several = combined(keys, of[owners])
            own, lead = ~several | (first == np.arange(keys.size)), owners[first[several]]
            ints = lambda x: pa.array(x.astype(np.int32))
            places = pa.StructArray.from_arrays([pa.array(keys[own]), ints(i[owners[own]])], names=["bucket", "i"])
            local = pa.StructArray.from_arrays([pa.array(keys[several]), ints(i[owners[several]]), pa.array(rids[of[lead]]), ints(i[lead])], names=["bucket", "i", "leader", "leader_i"])
            cut = lambda at, values: pa.ListArray.from_arrays(ints(at), values)
            every = np.arange(len(texts) + 1)
            lists = [cut(rows, ints(starts)), cut(rows, ints(sizes)), cut(rows, pa.array(is_line))]
            joined = pa.array([b"".join(nodes[s:e]) for s, e in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)], pa.binary())
            bands = [cut(np.searchsorted(of[owners[own]], every), places), cut(np.searchsorted(of[owners[several]], every), local)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists, joined, *bands], names=schema.names)

    return base.mapInArrow(run, schema)


def _shared_places(found: DataFrame) -> DataFrame:
    """(bucket, doc_id, key, start, n, line, node) of the paragraphs that share a band with one of another row, once for each band."""
    own = shared_buckets(found.select("rid", F.explode("own").alias("o")).select("o.bucket", "rid", "o.i"), "rid", "i").select("bucket", "rid", "i")
    local = found.select("rid", F.explode("local").alias("l")).select("l.bucket", "rid", "l.i")
    of_row = own.union(local).groupBy("rid").agg(F.collect_set(F.struct("bucket", "i")).alias("places"))
    each = found.drop("own", "local").join(of_row, "rid").select("doc_id", "key", "starts", "sizes", "lines", "nodes", F.explode("places").alias("p"))
    i = F.col("p.i")
    return each.select(F.col("p.bucket").alias("bucket"), "doc_id", "key", F.get("starts", i).alias("start"), F.get("sizes", i).alias("n"), F.get("lines", i).alias("line"), F.expr("substring(nodes, 16 * p.i + 1, 16)").alias("node"))


def _words_of(docs: DataFrame, asked: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, w) of each (key, start, n, node) asked for: the paragraph's words, separated by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, out = [], []
            for t, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = split_words(t)
                for p in places:
                    nodes.append(p["node"])
                    out.append(b" ".join(words[p["start"] : p["start"] + p["n"]]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(out, pa.binary())], names=["node", "w"])

    places = asked.groupBy("key").agg(F.collect_list(F.struct("start", "n", "node")).alias("places"))
    return _keyed(docs, doc_id, text).join(places, "key").select("t", "places").mapInArrow(run, "node binary, w binary").dropDuplicates(["node"])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(row_key(F.col(quoted(doc_id)), F.col(quoted(text))).alias("key"), F.col(quoted(text)).alias("t"))


def classified(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, start, n, line, first, source) of the paragraphs in a class of several documents.

    ``first``: its first place; ``source``: that, or the place of the same document where the paragraph stands word for word.
    """
    found = scratch.table(paragraphs(docs, doc_id, text))
    n_rows = found.count()
    places = scratch.table(_shared_places(found), scratch.tasks(n_rows))
    scratch.drop(found)
    bucket = Window.partitionBy("bucket")
    sharing = places.select("bucket", "node").withColumn("least", F.min("node").over(bucket)).withColumn("most", F.max("node").over(bucket)).filter("least != most")
    members = scratch.table(sharing.select("bucket", "node", F.lit(1).alias("n"), F.struct(F.col("least").alias("node"), F.lit(1).alias("n")).alias("first")).distinct(), scratch.tasks(n_rows))
    # a node however common is summed up before it meets anything
    per_node = places.groupBy("node").agg(F.min(F.struct("doc_id", "key", "start")).alias("first"), F.max(F.struct("doc_id", "key")).alias("last"), F.min(F.struct("key", "start", "n")).alias("p"))
    per_node = scratch.table(per_node, scratch.tasks(n_rows))
    asked = per_node.join(members.select("node").distinct(), "node", "left_semi").select("p.*", "node")
    payload = scratch.table(_words_of(docs, asked, doc_id, text), scratch.tasks(n_rows))
    roots, _ = link_classes(members, payload, rule(least), scratch)
    rooted = per_node.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first", "last")
    classes = rooted.groupBy("root").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter(F.col("first.key") != F.col("last.key"))
    # in the first document itself, the place with the very words
    source = F.when(F.col("own.key") == F.col("first.key"), F.col("own")).otherwise(F.col("first"))
    wanted = rooted.select("node", "root", F.col("first").alias("own")).join(classes, "root").select("node", "first", source.alias("source"))
    wanted = scratch.table(wanted, scratch.tasks(n_rows))
    out = scratch.table(places.drop("bucket").distinct().join(wanted, "node").drop("node"), scratch.tasks(n_rows))
    scratch.drop(places, members, per_node, payload, wanted)
    return out


def _around(docs: DataFrame, asked: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, start, end, before, after): the ``REACH`` words next to each stretch asked for, nearest first, separated by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, t, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = split_words(t)
                out += [(key, p["start"], p["end"], b" ".join(w[max(0, p["start"] - REACH) : p["start"]][::-1]), b" ".join(w[p["end"] : p["end"] + REACH])) for p in places]
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "start", "end", "before", "after"])

    places = asked.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("places"))
    return _keyed(docs, doc_id, text).join(places, "key").select("key", "t", "places").mapInArrow(run, "key binary, start int, end int, before binary, after binary").dropDuplicates(["key", "start", "end"])


def _merged(runs: DataFrame, *by: str) -> DataFrame:
    """Stretches (start, end) with equal ``by`` that overlap or adjoin, as one."""
    line = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy(*by, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def _grown(runs: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``runs`` (key, first_key, shift, start, end), carried on as far as the words agree with the first occurrence."""
    there = lambda name: (F.col(name) - F.col("shift")).cast("int")
    asked = runs.select("key", "start", "end").union(runs.select("first_key", there("start"), there("end"))).distinct()
    near = _around(docs, asked, doc_id, text)
    ours = runs.withColumn("first_start", there("start")).withColumn("first_end", there("end")).join(near, ["key", "start", "end"])
    theirs = near.select(F.col("key").alias("first_key"), F.col("start").alias("first_start"), F.col("end").alias("first_end"), F.col("before").alias("b"), F.col("after").alias("a"))
    kept = ["doc_id", "key", "first", "first_key", "shift"]

    def agree(x: bytes, y: bytes) -> int:
        if x == y:
            return len(x.split())
        return sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(x.split(), y.split(), strict=False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, b, after, a = (batch.column(c).to_pylist() for c in ("before", "b", "after", "a"))
            left, right = (np.array([agree(x, y) for x, y in zip(*c, strict=True)], np.int32) for c in ((before, b), (after, a)))
            ends = [pa.array(batch.column("start").to_numpy() - left), pa.array(batch.column("end").to_numpy() + right)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *ends], names=[*kept, "start", "end"])

    both = ours.join(theirs, ["first_key", "first_start", "first_end"]).select(*kept, "start", "end", "before", "b", "after", "a")
    return both.mapInArrow(run, runs.select(*kept, "start", "end").schema)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, start_word, n_words, class_id, removed): what several documents share, as lines and as passages.

    Words are lower-cased runs of letters and digits; ``start_word`` counts from 0. ``class_id``: the first document that
    holds it; ``removed``: that is another place. A removed passage is as long as it agrees word by word with its first
    occurrence, which has a row of its own; passages of different first occurrences may overlap. Documents that share
    nothing have no row; null and empty texts and an empty table give none. Rows that repeat a doc_id and its text are one
    document; null doc_ids are told apart by their texts, and come first. Texts are covered whole, whatever their length.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    found = classified(docs, scratch, doc_id, text)
    place = F.struct("doc_id", "key", "start")
    shown = lambda df, kind, removed: df.select("doc_id", F.lit(kind).alias("kind"), F.col("start").cast("long").alias("start_word"), (F.col("end") - F.col("start")).cast("long").alias("n_words"), "class_id", removed.alias("removed"))
    end = (F.col("start") + F.col("n")).alias("end")
    lines = shown(found.filter("line").select("doc_id", "key", "start", end, F.col("first.doc_id").alias("class_id"), "first"), "line", ~place.eqNullSafe(F.col("first")))
    windows = found.filter(~F.col("line") & (F.col("key") != F.col("source.key"))).select("doc_id", "key", "start", end, F.col("source.doc_id").alias("first"), F.col("source.key").alias("first_key"), (F.col("start") - F.col("source.start")).alias("shift"))
    by = ["doc_id", "key", "first", "first_key", "shift"]
    grown = scratch.table(_merged(_grown(scratch.table(_merged(windows, *by)), docs, doc_id, text), *by))
    passages = grown.withColumn("class_id", F.col("first"))
    mirrored = grown.select(F.col("first").alias("doc_id"), F.col("first_key").alias("key"), (F.col("start") - F.col("shift")).alias("start"), (F.col("end") - F.col("shift")).alias("end")).distinct()
    firsts = _merged(mirrored, "doc_id", "key").withColumn("class_id", F.col("doc_id"))
    return lines.union(shown(passages, "passage", F.lit(True))).union(shown(firsts, "passage", F.lit(False)))
