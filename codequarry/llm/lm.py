"""Language-model scores by stupid backoff over n-gram counts of the whole corpus.

The model is relational: a table of (n-gram, count) for each order, partitioned by n-gram hash, that the documents'
n-grams are joined with and summed per document. S(w | u v) is c(u v w) / c(u v) if the corpus has the trigram
``MIN_COUNT`` times, else 0.4 S(w | v); S(w | v) is c(v w) / c(v) if it has the bigram so often, else 0.4 c(w) / N. A
document's score is the mean of log S over its words, the first by c(w) / N and the second by S(w | v). An n-gram
that stands once in the corpus stands only where it is being scored, so it tells nothing and backs off. With ``order``
2, contexts are one word long.

Scale: rows of single n-grams would be the size of the corpus several times over. Instead documents are dealt into
batches by hash; each batch sends each of its distinct n-grams once, with its count there, as packed arrays by hash
partition (request), and gets the corpus counts back in the same order (reply). So n-grams are combined before the shuffle, no n-gram however
frequent sends more than one entry per batch, and each request takes about five bytes. Batches and partitions grow
in number with the corpus and keep their size; a batch names the partitions that it has n-grams for, and no others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import hashed_words, mixed
from .shared import ALNUM_WORD, quoted

BACKOFF, MIN_COUNT = 0.4, 2
#: Bytes of text in a batch, about; n-grams requested of a partition, about.
BATCH_BYTES, PART_GRAMS = 8 << 20, 1 << 20
#: Bits of an n-gram's hash. Two of 10^10 distinct n-grams agree with a chance of about one in a thousand each.
BITS = 56


def order_grams(words: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams (1 to 3 words) of texts that follow each other, and the position of their last words."""
    if order == 1:
        return words >> np.uint64(64 - BITS), np.arange(words.size)
    place = np.arange(words.size) - np.repeat(bounds[:-1], np.diff(bounds))
    at = np.flatnonzero(place >= order - 1)
    out = words[at - order + 1]
    for k in range(order - 2, -1, -1):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[at - k])
    return out >> np.uint64(64 - BITS), at


def pack(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 as gaps of as few bytes each as the largest needs."""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(gaps[1:].max()).bit_length() + 7) // 8) if values.size > 1 else 1
    return bytes([width]) + values[:1].tobytes() + gaps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    width, head = data[0], np.frombuffer(data, "<u8", 1, 1)
    rest = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((rest.shape[0], 8), np.uint8)
    gaps[:, :width] = rest
    return np.cumsum(np.concatenate((head, gaps.reshape(-1).view("<u8"))), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as one byte each; those of 255 or more follow as uint64."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n)
    return out


def score_texts(words: np.ndarray, bounds: np.ndarray, tables: dict[int, tuple[np.ndarray, np.ndarray]], total: int) -> np.ndarray:
    """Sum of log S over each text. ``tables``: by order, from 1 on, (sorted n-grams, corpus counts)."""
    shorter = np.full(words.size, max(total, 1), np.int64)
    logs = np.zeros(words.size)
    for order, (grams, counts) in sorted(tables.items()):
        gram, at = order_grams(words, bounds, order)
        c = np.zeros(words.size, np.int64)
        if gram.size:
            c[at] = counts[np.searchsorted(grams, gram)]
        of = shorter[at] if order == 1 else shorter[at - 1]
        known = np.log(np.maximum(c[at], 1) / np.maximum(of, 1))
        logs[at] = known if order == 1 else np.where(c[at] >= MIN_COUNT, known, math.log(BACKOFF) + logs[at])
        shorter = c
    return np.array([logs[s:e].sum() for s, e in zip(bounds[:-1], bounds[1:], strict=True)])


def _parts(grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` equal ranges of hashes the sorted ``grams`` lie in, and where each of those begins, and the end.

    Only ranges that have some are named, so the work follows the n-grams, however many ranges there are.
    """
    of = ((grams >> np.uint64(BITS - 32)) * np.uint64(n)) >> np.uint64(32)
    begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))[: grams.size]
    return of[begin].astype(np.int64), np.append(begin, grams.size)


def _request(batch_docs: pa.Table, parts: dict[int, int]) -> Iterator[tuple[int, int, bytes, bytes]]:
    words, bounds = hashed_words(batch_docs.column("t").to_pylist())
    for order, n in parts.items():
        grams, counts = np.unique(order_grams(words, bounds, order)[0], return_counts=True)
        of, cuts = _parts(grams, n)
        for part, s, e in zip(of.tolist(), cuts[:-1], cuts[1:], strict=True):
            yield order, part, pack(grams[s:e]), pack_counts(counts[s:e])


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES, part_grams: int = PART_GRAMS, order: int = 2) -> DataFrame:
    """(doc_id, n_words, log_prob, score) of every row, under the counts of all rows.

    Words are lower-cased runs of letters and digits. A text without words, or null, has n_words 0, log_prob 0 and a
    null score. ``order``: words of the longest n-grams. Repeated rows count, and are scored, each on its own. Texts are counted whole.
    """
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    size, total = docs.agg(F.sum(F.octet_length(t)), F.sum(F.regexp_count(t, F.lit(ALNUM_WORD)).cast("long"))).first()
    total = total or 0
    batches = max(1, -(-(size or 0) // batch_bytes))
    parts = {n: max(1, -(-total // (2 * part_grams if n == 1 else part_grams))) for n in range(1, order + 1)}
    base = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), t.alias("t"), F.pmod(F.xxhash64(F.col(quoted(doc_id)).cast("string"), t), F.lit(batches)).alias("batch"))

    def request(key: tuple, table: pa.Table) -> pa.Table:
        rows = list(_request(table, parts))
        return pa.table({"batch": pa.array([key[0].as_py()] * len(rows), pa.int64()), "order": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([r[1] for r in rows], pa.int64()), "grams": pa.array([r[2] for r in rows], pa.binary()), "counts": pa.array([r[3] for r in rows], pa.binary())})

    def count(key: tuple, table: pa.Table) -> pa.Table:
        asked = [unpack(g.as_py()) for g in table.column("grams")]
        own = [unpack_counts(c.as_py(), g.size) for c, g in zip(table.column("counts"), asked, strict=True)]
        grams, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.zeros(grams.size, np.int64)
        np.add.at(counts, inverse, np.concatenate(own))
        ends = np.cumsum([g.size for g in asked])
        back = [pack_counts(counts[inverse[e - g.size : e]]) for g, e in zip(asked, ends, strict=True)]
        return pa.table({"batch": table.column("batch"), "order": table.column("order"), "part": table.column("part"), "counts": pa.array(back, pa.binary())})

    def answer(key: tuple, texts: pa.Table, replies: pa.Table) -> pa.Table:
        words, bounds = hashed_words(texts.column("t").to_pylist())
        tables = {}
        for order in parts:
            grams = np.unique(order_grams(words, bounds, order)[0])
            mine = {p: c for o, p, c in zip(*(replies.column(x).to_pylist() for x in ("order", "part", "counts")), strict=True) if o == order}
            of, cuts = _parts(grams, parts[order])
            tables[order] = grams, np.concatenate([np.empty(0, np.int64), *(unpack_counts(mine[p], n) for p, n in zip(of.tolist(), np.diff(cuts).tolist(), strict=True))])
        sums, n = score_texts(words, bounds, tables, total), np.diff(bounds)
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(n, pa.int64()), "log_prob": pa.array(sums, pa.float64())})

    requests = base.groupBy("batch").applyInArrow(request, "batch long, order int, part long, grams binary, counts binary")
    replies = requests.groupBy("order", "part").applyInArrow(count, "batch long, order int, part long, counts binary")
    out = base.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(answer, "doc_id long, n_words long, log_prob double")
    return out.withColumn("score", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))
