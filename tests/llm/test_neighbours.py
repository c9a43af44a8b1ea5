import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, k=10, every=10):
    """Nearest others by double precision, ties to the smaller id; rows without a usable vector left out."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids, vectors = [i for i, _ in good], [np.array(v, np.float64) for _, v in good]
    out = {}
    for q, v in good:
        if q % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in zip(ids, vectors, strict=True) if len(w) == len(v) and not (i == q and (v == w).all()))
            out.setdefault(q, []).extend((r + 1, i, round(s, 9)) for r, (s, i) in enumerate(near[:k]))
    return {q: sorted(x) for q, x in out.items()}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    return {q: sorted(x) for q, x in out.items()}


def f32(v):
    return [float(np.float32(x)) for x in v]


def test_odd_vectors_copies_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f32(rng.standard_normal(8))) for i in range(300)]
    hot = f32(rng.standard_normal(8))
    rows += [(1000 + i, hot) for i in range(150)]  # a third of the rows are one vector
    rows += [(2000 + i, f32(rng.integers(-1, 2, 8))) for i in range(120)]  # many equal distances
    rows += [(10, None), (20, []), (30, [0.0] * 8), (40, [None] + [1.0] * 7), (50, [float("nan")] * 8), (60, [float("inf")] * 8), (None, hot), (70, [1.0, 2.0]), (80, [-0.0, 2.0]), (81, [0.0, 2.0]), (90, [5.0])]
    rows += rows[:3]  # repeated rows
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(5)
    got = found(neighbours.search(df, F.col("vec_id") % 10 == 0))
    assert {q: x for q, x in brute_force(rows).items() if x} == got


def test_fewer_than_k_and_no_rows(spark):
    assert neighbours.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).collect() == []
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [3.0, 0.0], 1)], SCHEMA)
    assert found(neighbours.search(df, F.col("vec_id") % 10 == 0)) == {0: [(1, 1, round(math.sqrt(2), 9)), (2, 2, 2.0)]}


@pytest.mark.parametrize("d", [16, 200])
def test_recall_beyond_the_sample(spark, d, monkeypatch):
    """The sample is a small part of the vectors, so nearly all of them are found by their codes."""
    monkeypatch.setattr(neighbours, "SAMPLE", 400)
    monkeypatch.setattr(neighbours, "INDEX_BLOCK", 128)
    rng = np.random.default_rng(d)
    centres = rng.standard_normal((20, d))
    rows = [(i, f32(centres[i % 20] * (i % 3 > 0) + rng.standard_normal(d))) for i in range(6000)]
    want = brute_force(rows, every=100)
    got = found(neighbours.search(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), F.col("vec_id") % 100 == 0))
    hits = sum(len({x[1] for x in want[q]} & {x[1] for x in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.98


def test_codes_pass_over_most_vectors_and_their_bounds_hold():
    rng = np.random.default_rng(1)
    d = 128
    x = np.repeat(rng.standard_normal((200, d)), 20, axis=0) + 0.3 * rng.standard_normal((4000, d))
    m = neighbours.Model(x[:40])
    bits, length, fit = m.encode(x, 0)
    q = x[::80] + 0.3 * rng.standard_normal((50, d))
    away = q - m.centres[0]
    to_centre = np.sqrt((away**2).sum(1))
    low, high = neighbours.bounds(bits, length, fit, d, away / to_centre[:, None] @ m.rotation, to_centre)
    exact = ((q[:, None] - x[None]) ** 2).sum(2)
    assert ((low <= exact) & (exact <= high)).mean() > 0.999
    assert bits.shape == (4000, d // 8)
    tenth = np.partition(high, 10, axis=1)[:, 10]
    assert (low <= tenth[:, None]).mean() < 0.1


def test_the_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found(queries.op12_nearest_neighbours(spark, sf)) == brute_force(rows, every=100)
