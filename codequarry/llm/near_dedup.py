"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is its sequence of words. A sketch hashes its occurrence-labelled k-mers with a function of its
own, takes those with the two to four least hashes and keeps the order in which they stand in the text. Documents that agree on
a sketch are candidates; they are near duplicates if the word edit distance, computed by alignment within the band
that the threshold allows, leaves a similarity of 0.8 or more.

K-mers have five words, in texts of fewer than 500 words two to four (``SHORT``): of a text of nine words no k-mer of five outlives
an edit in the middle. The chance to agree on a sketch is the square of the k-mers' similarity. If edits are scattered in a long text, that is
0.8^5 / (2 - 0.8^5) = 0.196 for pairs at the threshold, and such a pair is missed with a chance of (1 - 0.196^2)^64, eight in a
hundred; at an edit similarity of 0.9 (0.42), of five in a million. Tests measure every length.

Scale: documents of a batch with equal words, or that agree on a sketch, go on as one row each batch; see ``linking``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from .decontaminate import pieces, split_words
from .hashing import hashed_words, labelled, mixed, text_kmers
from .linking import Rule, combined, link_classes, shared_buckets
from .shared import TAGGED_ROWS, Scratch, exact_tags, fresh, quoted, row_key, tagged, tags

#: Words in a k-mer; least similarity; sketches; k-mers in a sketch.
K, SIMILARITY, SKETCHES, PICKED = 5, 0.8, 64, 2
#: (words that a text has fewer of, words in a k-mer, k-mers in a sketch) of shorter texts, in which few edits leave no k-mer of five words.
#: Limits are further apart than lengths of similar texts.
SHORT = ((8, 2, 2), (16, 2, 3), (28, 3, 2), (48, 2, 4), (500, 4, 2))
#: Characters whose k-mers are sketched together.
TOGETHER = 1 << 19
_ODD = (np.random.default_rng(20240501).integers(0, 1 << 63, SKETCHES * 4, np.uint64) << np.uint64(1)) | np.uint64(1)


def sketches(words: np.ndarray, bounds: np.ndarray, n: int = SKETCHES, picked: int = PICKED, k: int = K, salt: int = 0) -> np.ndarray:
    """One key per text and sketch (a row of ``n``; of a text without words, zeros): the ``picked`` least k-mers by the
    sketch's own hash, in text order. Texts follow each other in ``words``.

    The last bits of a hash are replaced by the k-mer's place, so that the least hash tells where it stands.
    """
    grams, ends = text_kmers(words, bounds, k)
    out = np.zeros((bounds.size - 1, n), np.uint64)
    live = np.flatnonzero(np.diff(ends) > 0)
    if not live.size:
        return out.view(np.int64)
    grams, starts, size = labelled(grams, ends), ends[:-1][live], np.diff(ends)[live]
    mask = np.uint64((1 << int(grams.size).bit_length()) - 1)
    place, h, t = np.arange(grams.size, dtype=np.uint64), np.empty_like(grams), np.empty_like(grams)
    for i in range(n):
        np.multiply(np.bitwise_xor(grams, _ODD[i], out=h), np.uint64(0xFF51AFD7ED558CCD), out=h)
        np.bitwise_xor(h, np.right_shift(h, np.uint64(32), out=t), out=h)
        np.multiply(h, np.uint64(0xC4CEB9FE1A85EC53), out=h)
        np.bitwise_or(np.bitwise_and(h, ~mask, out=h), place, out=h)
        picks = []
        for j in range(picked):
            at = (np.minimum.reduceat(h, starts) & mask).astype(np.int64)
            picks.append(np.where(size > j, at, picks[0]) if j else at)
            h[picks[-1]] = ~np.uint64(0)
        key = np.full(live.size, i + 1 + salt * n, np.uint64)
        for at in np.sort(np.stack(picks), axis=0):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + grams[at])
        out[live, i] = key
    return out.view(np.int64)


def bucket_keys(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of all sketches of texts that follow each other, by text. Texts without words have none.

    A text has the sketches of its own length, and those of the length of the shortest text that is similar to it, if these are others: so two
    similar texts have those of one length in common.
    """
    n = np.diff(bounds)
    limits = [limit for limit, _, _ in SHORT]
    form, shorter = np.searchsorted(limits, n, "right"), np.searchsorted(limits, np.ceil(SIMILARITY * n - 1e-9), "right")
    texts, keys = [], []
    for f, (k, picked) in enumerate([*((k, picked) for _, k, picked in SHORT), (K, PICKED)]):
        own = np.flatnonzero((n > 0) & ((form == f) | (shorter == f)))
        if own.size:
            part = np.concatenate([words[bounds[t] : bounds[t + 1]] for t in own])
            found = sketches(part, np.concatenate(([0], np.cumsum(n[own]))), picked=picked, k=k, salt=len(SHORT) - f)
            texts.append(np.repeat(own, found.shape[1]))
            keys.append(found.ravel())
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    texts, keys = np.concatenate(texts), np.concatenate(keys)
    order = np.argsort(texts, kind="stable")
    return texts[order], keys[order]


def distance_within(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edit distance of two sequences, or ``most + 1`` if it is larger: only a band of diagonals is computed.

    The band is a column of bits that moves down the diagonal, one step for each word of ``b``; vertical differences
    are kept as two bit vectors (Myers; Hyyrö for the band).
    """
    if a.size < b.size:
        a, b = b, a
    if a.size - b.size > most:
        return most + 1
    same = np.flatnonzero(a[: b.size] != b)
    head = int(same[0]) if same.size else b.size
    a, b = a[head:], b[head:]
    if b.size:
        differ = np.flatnonzero(a[::-1][: b.size] != b[::-1])
        tail = int(differ[0]) if differ.size else b.size
        a, b = a[: a.size - tail], b[: b.size - tail]
    if not b.size:
        return int(a.size)
    most = min(most, int(a.size))
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    # at word j of b, bit t stands for word j - most + t of a; the score is that of the lowest cell within a
    vp, vn, score, end = full ^ ((1 << most) - 1), 0, most, int(a.size) - most
    for j, x in enumerate(b.tolist()):
        mask, shift = where.get(x, 0), j - most
        eq = (mask >> shift if shift >= 0 else mask << -shift) & full
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j < end:  # down the diagonal
            score += not d0 & top
        else:  # the last word of a rises in the band
            last = 1 << (width - 2 - (j - end))
            score += bool(hp & last) - bool(hn & last)
        # to the right the score falls by one a step at most
        if score - (b.size - max(j + 1, end)) > most:
            return most + 1
        down = d0 >> 1
        vp = (hn | ~(down | hp)) & full
        vn = down & hp
    return min(score, most + 1)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether word edit distance over the longer length leaves a similarity of ``least`` or more.

    Words that the other text lacks all cost an edit, so most pairs need no alignment; the others are aligned within
    narrow bands first.
    """
    longer = max(a.size, b.size)
    most = int((1 - least) * longer + 1e-9)
    if longer == 0 or abs(a.size - b.size) > most:
        return longer == 0
    common = np.intersect1d(*_features([a, b]), assume_unique=True).size
    if longer - common > most:
        return False
    return any(distance_within(a, b, m) <= m for m in (most // 16, most // 4) if m >= 8) or distance_within(a, b, most) <= most


def _features(items: list[np.ndarray]) -> list[np.ndarray]:
    bounds = np.cumsum([0, *(w.size for w in items)])
    return np.split(labelled(np.concatenate(items).astype(np.uint64), bounds), bounds[1:-1])


def rule(least: float = SIMILARITY) -> Rule:
    """Words that two texts don't share, each counted as often as it stands, all cost an edit."""
    most = lambda longer: ((1 - least) * longer + 1e-9).astype(np.int64)
    return Rule(
        lambda a, b: similar(a, b, least), _features, lambda common, a, b: np.maximum(a, b) - common <= most(np.maximum(a, b)),
        lambda w: np.frombuffer(w, np.uint32), least,
    )


_LOCAL = ArrayType(StructType().add("bucket", LongType()).add("leader", BinaryType()).add("leader_n", IntegerType()))


def _sketched(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, node, n, own, local) of every row.

    ``node``: digest of the words, null without words; ``n``: words. Among a batch's rows, ``own`` has the sketches of
    those for which this row stands, and ``local`` those that several have, with the row that stands for them.
    """
    base = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), row_key(F.col(quoted(doc_id)), F.col(quoted(text))).alias("key"), F.col(quoted(text)).alias("_t"))
    schema = base.drop("_t").schema.add("node", BinaryType()).add("n", IntegerType()).add("own", ArrayType(LongType())).add("local", _LOCAL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            nodes, sizes, parts, owned = [], [], [], []
            for lo, hi in pieces(texts, TOGETHER):
                words, bounds = hashed_words(texts[lo:hi])
                size = np.diff(bounds)
                sizes.append(size)
                nodes += [_digest(t) if n else None for t, n in zip(texts[lo:hi], size, strict=True)]
                of, keys = bucket_keys(words, bounds)
                owned.append(of + lo)
                parts.append(keys)
            n, number = np.concatenate(sizes).astype(np.int32), {}
            stands = np.array([x is not None and number.setdefault(x, k) == k for k, x in enumerate(nodes)], bool)
            owners, keys = np.concatenate(owned), np.concatenate(parts)
            owners, keys = owners[stands[owners]], keys[stands[owners]]
            first, several = combined(keys, owners)
            own = first == np.arange(keys.size)
            rows = np.arange(len(texts) + 1)
            lead = owners[first[several]]
            local = pa.StructArray.from_arrays([pa.array(keys[several]), pa.array([nodes[k] for k in lead], pa.binary()), pa.array(n[lead])], names=["bucket", "leader", "leader_n"])
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(owners[of], rows).astype(np.int32)), values) for of, values in ((own, pa.array(keys[own])), (several, local))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes, pa.binary()), pa.array(n), *lists], names=["doc_id", "key", "node", "n", "own", "local"])

    return base.mapInArrow(run, schema)


def _digest(text: str | None) -> bytes:
    return blake2b(b" ".join(split_words(text)), digest_size=16).digest()


def _node_words(docs: DataFrame, wanted: DataFrame, n_rows: int, doc_id: str, text: str) -> DataFrame:
    """(node, w) of one document, at least, for each wanted (key): the words as 32-bit hashes. A few nodes that aren't wanted may be there too."""
    base = docs.select(row_key(F.col(quoted(doc_id)), F.col(quoted(text))).alias("key"), F.col(quoted(text)).alias("t"))
    base = tagged(base, "key", tags(wanted, n_rows), n_rows) if n_rows <= TAGGED_ROWS else base.join(wanted.select("key"), "key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            words, bounds = hashed_words(texts)
            w = [words[s:e].astype(np.uint32).tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, texts), pa.binary()), pa.array(w, pa.binary())], names=["node", "w"])

    return base.select("t").mapInArrow(run, "node binary, w binary").dropDuplicates(["node"])


def _members(rows: DataFrame) -> DataFrame:
    """(bucket, node, n, first) of every sketch that several nodes have."""
    own = shared_buckets(rows.select("node", "n", F.explode("own").alias("bucket")).select("bucket", "node", "n"), "node", "n")
    local = rows.select("node", "n", F.explode("local").alias("l")).select("l.bucket", "node", "n", F.struct(F.col("l.leader").alias("node"), F.col("l.leader_n").alias("n")).alias("first"))
    return own.unionByName(local)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, root, class_id, n_links, n_class) for every row of ``docs``; ``root`` is the class itself.

    Rows are in one class if links of near duplicates or equal words join them; ``class_id`` is its least doc_id, and
    ``key`` tells rows apart that share a doc_id. ``n_links``: verified links of the row's text to different texts.
    Documents without words (null, empty or blank texts) are each a class of their own, with their repeated rows; a null doc_id is no class's id
    unless all of its rows have none. Repeated rows fall in one class. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    rows = scratch.table(_sketched(docs, doc_id, text))
    n_rows = rows.count()
    members = scratch.table(_members(rows), scratch.tasks(n_rows))
    wanted = rows.join(members.select("node").distinct(), "node").groupBy("node").agg(F.min("key").alias("key"))
    texts = scratch.table(_node_words(docs, wanted, n_rows, doc_id, text), scratch.tasks(n_rows))
    roots, links = link_classes(members, texts, rule(least), scratch)
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    linked = scratch.table(roots.join(ends, "node", "left"), scratch.tasks(n_rows))
    scratch.drop(members, texts)
    of = rows.select("doc_id", "key", "node").join(linked, "node", "left")
    # rows without words stand alone
    alone = F.encode(F.concat_ws(":", F.lit("alone"), F.hex("key")), "utf-8")
    of = scratch.table(of.select("doc_id", "key", F.coalesce("root", "node", alone).alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), scratch.tasks(n_rows))
    ids = of.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_class"))
    return of.join(ids, "root").select("doc_id", "key", "root", "class_id", "n_links", "n_class")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One document of each class, that with the least doc_id, with all columns; of repeated rows, any one.

    A row without letters and digits goes only if it repeats another. Texts don't move: tags of the keys that go are sent to them, with the few other keys of those tags. Only
    of very many rows texts are dealt out by their keys. Rows of a key that stays but is repeated, if there are any, are combined.
    """
    scratch = Scratch(docs.sparkSession, "deduplicate")
    every = scratch.table(classes(docs, doc_id, text, least).select("doc_id", "key", "root", "n_class"))
    found = scratch.table(every.filter(F.col("n_class") > 1).groupBy("root", "key").agg(F.min(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("doc_id"), F.count(F.lit(1)).alias("n")))
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    named = scratch.table(found.join(first, "root").select("key", "n", (F.col("key") == F.col("first.key")).alias("stays")))
    columns = [F.col(quoted(c)) for c in docs.columns]
    key, n_rows = fresh(docs.columns, "_key"), every.count()
    keyed = docs.withColumn(key, row_key(F.col(quoted(doc_id)), F.col(quoted(text))))

    def of(keys: DataFrame, how: str) -> DataFrame:
        if n_rows > TAGGED_ROWS:
            return keyed.join(keys.select(F.col("key").alias(key)), key, how)
        return tagged(keyed, key, scratch.table(exact_tags(keys, every, n_rows)), n_rows, how)

    kept = of(named.filter("not stays or n > 1"), "left_anti").select(*columns)
    repeated = named.filter("stays and n > 1")
    if repeated.isEmpty():
        return kept
    one = of(repeated, "left_semi").groupBy(key).agg(F.first(F.struct(*columns)).alias("_row"))
    return kept.union(one.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]))
