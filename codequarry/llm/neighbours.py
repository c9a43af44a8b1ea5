"""Nearest neighbours by randomly rotated one-bit codes.

A vector is stored as its residual from the nearest of a few centroids: one bit per rotated component, the residual's
length, and the inner product of the residual's direction with its own code. From these the inner product with any query
is estimated without bias; the estimate's error is bounded by a multiple of what the code leaves out. Vectors whose
lower bound on the distance exceeds the best known k-th distance are passed over, all others are measured on their
original components, in double precision.

Equal vectors are one class with its k + 1 least ids, so copies cost nothing; every class is indexed. Classes are dealt
into rings around their centroid, queries into blocks as well; pairs of blocks are met where the triangle inequality
doesn't rule it out. From a pair come at most k + 1 ids per query, and the ids of a query are ranked last. Nothing but a
sample of bounded size reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import numbering
from .shared import Scratch

#: The index is fitted on at most so many vectors, and bytes of them: those with the least hash of their components.
SAMPLE, SAMPLE_BYTES = 8192, 16 << 20
CENTROIDS, STEPS, SEED = 64, 8, 20
#: Half the width of the error bound, in standard deviations of an estimate (which are 1 / sqrt(d - 1) of what the code leaves out).
WIDTH = 3.5
#: Most classes in a block of the index, queries in a block, and bytes of the vectors of either.
INDEX_BLOCK, QUERY_BLOCK, BLOCK_BYTES = 4096, 1024, 8 << 20


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for the same ``d`` everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float64)


class Model:
    """Centroids of vectors of one length, and exact bounds on k-th distances from the sample."""

    def __init__(self, sample: np.ndarray, seed: int = SEED):
        self.d = sample.shape[1]
        self.sample = sample
        self.rotation = rotation(self.d, seed)
        rng = np.random.default_rng([seed, self.d, 1])
        n = min(CENTROIDS, max(1, len(sample) // 32))
        centres = sample[np.sort(rng.choice(len(sample), n, replace=False))].copy()
        for _ in range(STEPS):
            own = self._nearest(sample, centres)
            size = np.bincount(own, minlength=n)
            total = np.zeros_like(centres)
            np.add.at(total, own, sample)
            centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
        self.centres = centres

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(x, self.centres)

    def encode(self, x: np.ndarray, centre: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed bits, lengths of the residuals, and inner products of their directions with their codes."""
        residual = (x - self.centres[centre]) @ self.rotation
        length = np.sqrt((residual**2).sum(1))
        bits = residual > 0
        fit = np.abs(residual).sum(1) / (np.maximum(length, 1e-300) * np.sqrt(self.d))
        return np.packbits(bits, axis=1), length, np.where(length > 0, fit, 1.0)

    def reach(self, queries: np.ndarray, k: int) -> np.ndarray:
        """For each query a distance within which k vectors other than its own lie for certain; infinity if the sample has too few.

        The query's own class may be in the sample, so the (k + 1)-th distance is taken; sampled vectors are distinct.
        """
        if len(self.sample) <= k:
            return np.full(len(queries), np.inf)
        out = np.empty(len(queries))
        for i in range(0, len(queries), 256):
            q = queries[i : i + 256]
            squared = (q**2).sum(1)[:, None] + (self.sample**2).sum(1) - 2 * (q @ self.sample.T)
            near = np.argpartition(squared, k, axis=1)[:, : k + 1]
            out[i : i + 256] = np.sqrt(((q[:, None, :] - self.sample[near]) ** 2).sum(2)).max(1)
        return out


def bounds(bits: np.ndarray, length: np.ndarray, fit: np.ndarray, d: int, turned: np.ndarray, to_centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds on squared distances, (queries, vectors): ``turned`` are the queries' rotated directions from the centroid, ``to_centre`` their distances from it."""
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
    cosine = (turned.astype(np.float32) @ signs.T) / np.float32(np.sqrt(d)) / fit.astype(np.float32)
    error = WIDTH * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(d - 1, 1))
    both = 2 * to_centre[:, None] * length
    middle = to_centre[:, None] ** 2 + length**2 - both * cosine
    return middle - both * (error + 1e-5), middle + both * (error + 1e-5)


def usable(vector: Column) -> Column:
    """Not null, some component not zero, and no component null or not finite."""
    # NaN equals NaN in Spark, and x - x is NaN for both infinities
    finite = F.forall(vector, lambda x: x.isNotNull() & (x - x == 0))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def search(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row of (vec_id, embedding) that fulfils ``queries``: its ``k`` nearest other rows.

    Smallest Euclidean distance first, ties to the smaller vec_id; all others if there are fewer than ``k``. Vectors that
    are null, all zero, empty, or hold null or non-finite components take no part, nor do rows without vec_id. Vectors
    of different lengths are no neighbours of each other. Rows that repeat (vec_id, embedding) are one row; of a vec_id with
    several vectors each is a row, asks for itself and may be found by the others. Other columns are ignored. Without rows the result is empty.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    v = F.col("embedding")
    rows = vectors.filter(usable(v) & F.col("vec_id").isNotNull()).select("vec_id", F.transform(v, lambda x: x.cast("double") + F.lit(0.0)).alias("v"), queries.alias("asks")).distinct()
    # a class of equal vectors by a digest of its components, and its least ids: more can't be among anyone's k nearest
    rows = rows.withColumn("class", F.unhex(F.sha2(F.to_json("v"), 256))).withColumn("d", F.size("v"))
    rows = scratch.table(rows)
    order = Window.partitionBy("class").orderBy("vec_id")
    ids = rows.select("class", "vec_id").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    ids = ids.groupBy("class").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = rows.groupBy("class").agg(F.first("v").alias("v"), F.first("d").alias("d"), F.max(F.coalesce("asks", F.lit(False))).alias("asks"))
    classes = scratch.table(classes.join(ids, "class"))

    found = None
    for (d,) in classes.select("d").distinct().orderBy("d").collect():
        part = _search(classes.filter(F.col("d") == d), d, k, scratch)
        found = part if found is None else found.union(part)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if found is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    # the k + 1 least of a class serve all its queries, each of which leaves out itself
    top = Window.partitionBy("class").orderBy("score", "vec_id")
    found = found.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1)
    best = found.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    asked = rows.filter("asks").select("class", F.col("vec_id").alias("query_id")).join(best, "class")
    others = F.slice(F.filter("best", lambda b: (b["vec_id"] != F.col("query_id")) | (b["score"] > 0)), 1, k)
    out = asked.select("query_id", F.posexplode(others).alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b")["vec_id"].alias("vec_id"), F.col("b")["score"].alias("score"))


def _search(classes: DataFrame, d: int, k: int, scratch: Scratch) -> DataFrame:
    """(class, score, vec_id): for each class that asks the k + 1 nearest ids of each pair of blocks that may hold any."""
    spark = classes.sparkSession
    most = max(k + 2, min(SAMPLE, SAMPLE_BYTES // (8 * d)))
    share = min(1.0, 2 * most / max(1, classes.count()))  # about twice as many as are taken: what is sorted for it doesn't grow
    sample = classes.select("class", "v").filter(F.xxhash64("class") <= int((share - 0.5) * 2.0**64) - (share == 1)).orderBy("class").limit(most).select("v").toArrow()
    shared = spark.sparkContext.broadcast(Model(_matrix(sample.column("v").combine_chunks(), d)))
    index_rows, query_rows = (max(64, min(n, BLOCK_BYTES // (8 * d))) for n in (INDEX_BLOCK, QUERY_BLOCK))
    one = lambda a: pa.array([a.tobytes()], pa.binary())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m, x = shared.value, _matrix(b.column("v"), d)
                own = m.nearest(x)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(np.sqrt(((x - m.centres[own]) ** 2).sum(1)))], names=[*b.schema.names, "centre", "length"])

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        x, ids = _matrix(t.column("v").combine_chunks(), d), t.column("ids").combine_chunks()
        bits, length, fit = shared.value.encode(x, key[0].as_py())
        return pa.table({"centre": [key[0]], "block": [key[1]], "nearest": [length.min()], "farthest": [length.max()], "bits": one(bits), "length": one(length), "fit": one(fit), "vectors": one(x), "ids": pa.array([ids.to_pylist()], pa.list_(ids.type))})

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        m, x = shared.value, _matrix(t.column("v").combine_chunks(), d)
        reach = m.reach(x, k)
        away = np.sqrt(np.stack([((x - c) ** 2).sum(1) for c in m.centres]))
        rings = [{"centre": c, "low": lo, "high": hi} for c, (lo, hi) in enumerate(zip((away - reach).min(1).tolist(), (away + reach).max(1).tolist(), strict=True))]
        kind = pa.list_(pa.struct([("centre", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))
        return pa.table({"queries_block": [key[0]], "queries": one(x), "reach": one(reach), "classes": pa.array([t.column("class").to_pylist()], pa.list_(pa.binary())), "rings": pa.array([rings], kind)})

    # blocks of one centroid each, by distance from it
    kind = classes.schema["ids"].dataType.simpleString()
    placed = classes.select("class", "v", "ids", "asks").mapInArrow(place, f"class binary, v array<double>, ids {kind}, asks boolean, centre int, length double")
    placed = numbering.numbered(placed, [F.col("length").asc(), F.col("class").asc()], scratch.table, "n", by=["centre"])
    index = scratch.table(placed.groupBy("centre", F.floor(F.col("n") / index_rows).alias("block")).applyInArrow(pack, f"centre int, block long, nearest double, farthest double, bits binary, length binary, fit binary, vectors binary, ids array<{kind}>"))
    asking = numbering.numbered(placed.filter("asks").select("class", "v", "centre"), [F.col("centre").asc(), F.col("class").asc()], scratch.table, "q")
    questions = scratch.table(asking.groupBy(F.floor(F.col("q") / query_rows).alias("queries_block")).applyInArrow(ask, "queries_block long, queries binary, reach binary, classes array<binary>, rings array<struct<centre:int,low:double,high:double>>"))
    # pairs that the triangle inequality leaves: some query of the one may have a neighbour in the other
    slack = 1e-9
    rings = questions.select("queries_block", F.inline("rings"))
    pairs = scratch.table(rings.join(index.select("centre", "block", "nearest", "farthest"), "centre").filter((F.col("farthest") >= F.col("low") - slack) & (F.col("nearest") <= F.col("high") + slack)).select("centre", "block", "queries_block"))

    def measure(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _pair(shared.value, {c: t.column(c)[0].as_py() for t in (left, right) for c in t.column_names}, d, k, left.schema.field("ids").type.value_type.value_type)

    key = ["centre", "block", "queries_block"]
    sides = (index.join(pairs, ["centre", "block"]).drop("nearest", "farthest"), questions.drop("rings").join(pairs, "queries_block"))
    return scratch.table(sides[0].groupBy(*key).cogroup(sides[1].groupBy(*key)).applyInArrow(measure, f"class binary, score double, vec_id {kind[len('array<') : -1]}"))


def _pair(m: Model, r: dict, d: int, k: int, kind: pa.DataType) -> pa.Table:
    """The nearest ids that a block of the index has for a block of queries."""
    centre = m.centres[r["centre"]]
    queries, reach = np.frombuffer(r["queries"]).reshape(-1, d), np.frombuffer(r["reach"])
    vectors, length, fit = np.frombuffer(r["vectors"]).reshape(-1, d), np.frombuffer(r["length"]), np.frombuffer(r["fit"])
    bits = np.frombuffer(r["bits"], np.uint8).reshape(len(vectors), -1)
    away = queries - centre
    to_centre = np.sqrt((away**2).sum(1))
    # within the least and greatest length of the block's residuals
    gap = np.maximum(np.maximum(to_centre - length.max(), length.min() - to_centre), 0)
    asks = np.flatnonzero(gap <= reach * (1 + 1e-9))
    classes, scores, ids = [], [], []
    for at in range(0, len(asks), 128):
        q = asks[at : at + 128]
        turned = (away[q] / np.maximum(to_centre[q], 1e-300)[:, None]) @ m.rotation
        low, high = bounds(bits, length, fit, d, turned, to_centre[q])
        limit = reach[q] ** 2 * (1 + 1e-9)
        if len(vectors) > k + 1:
            limit = np.minimum(limit, np.partition(high, k, axis=1)[:, k])
        for j, row in zip(q, low <= limit[:, None], strict=True):
            near = np.flatnonzero(row)
            if not near.size:
                continue
            exact = np.sqrt(((vectors[near] - queries[j]) ** 2).sum(1))
            if near.size > k + 1:  # ties of the last one stay
                keep = exact <= np.partition(exact, k)[k]
                near, exact = near[keep], exact[keep]
            own = sorted((s, i) for s, c in zip(exact.tolist(), near.tolist(), strict=True) for i in r["ids"][c])[: k + 1]
            classes += [r["classes"][j]] * len(own)
            scores += [s for s, _ in own]
            ids += [i for _, i in own]
    return pa.table([pa.array(classes, pa.binary()), pa.array(scores, pa.float64()), pa.array(ids, kind)], names=["class", "score", "vec_id"])
