"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words; every document of it an expected number of copies,
``target / source size``. The documents of a source stand on a line, each as long as its expected
copies; a document is emitted once for every point ``offset + integer`` within its part of the line.
So a document is taken the floor or the ceiling of its expected copies, and as the line is ordered by
size, the words taken stay within about one document of the target.

Scale: the prefix sum is made in two levels. Rows are dealt to (source, size class, lane) buckets of
bounded size, whose totals (one row per bucket, combined on the map side) give each bucket its start on
the line; a window runs within each bucket only. A hot source is cut into as many lanes as its row count
asks for. Copies are summed as integers of 2^-24, so the outcome does not depend on the order of
evaluation, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, fresh, quoted

#: No document is taken more often, and no target is above so many times its source.
MAX_COPIES = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Rows that share a window, about.
LANE_ROWS = 100_000
UNIT = 1 << 24
#: A table of up to so many sources is broadcast.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, source_rows) with a ``target`` for each source.

    Sources share the sum of all sizes by weight; a share above ``max_copies`` times its source's size
    is cut there and the excess reshared by weight. With the sources ordered by cap / weight, those cut
    form a prefix: source j is cut when its cap is below its weight times what is then left per weight.
    The table has a row per source, as a mixing recipe has; documents never meet here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    t = totals.withColumn("_rank", F.row_number().over(order) - 1)
    t = t.withColumn("_weight", F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("_cap", (F.col("source_size") * max_copies).cast("double"))
    line = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    everything = Window.partitionBy()
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_left", F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    t = t.withColumn("_weights_left", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    t = t.withColumn("_cut", F.col("_cap") < F.col("_left") * F.col("_weight") / F.col("_weights_left"))
    t = t.withColumn("_per_weight", F.max(F.when(~F.col("_cut"), F.col("_left") / F.col("_weights_left"))).over(everything))
    share = F.when(F.col("_cut"), F.col("_cap")).otherwise(F.col("_weight") * F.col("_per_weight"))
    return t.select("source", "source_size", "source_rows", F.least(share, F.col("_cap")).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """A random point in [0, UNIT) for each source, the same in every run of a seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\0null"))))
    return F.conv(F.substring(digest, 1, 6), 16, 10).cast("long")


def sample_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies``; ``carry``: columns to keep.

    Null texts have size 0; null sources form a source of their own, the last. A source without words has
    target 0 and no copies. Repeated rows are rows of their own; ties in size fall by doc_id. An empty table
    gives an empty result. Other columns of ``docs`` are not looked at.
    """
    base = docs.select(
        F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(source)).cast("string").alias("source"), word_count(F.col(quoted(text))).alias("size"),
        *[F.col(quoted(c)).alias(f"_carry_{i}") for i, c in enumerate(carry)],
    )
    base = base.withColumn("_class", F.floor(F.sqrt(F.col("size").cast("double"))).cast("long"))
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    targets = source_targets(totals, weights, max_copies)
    targets = targets.withColumn("_step", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("_lanes", F.ceil(F.col("source_rows") / LANE_ROWS).cast("long")).withColumn("_null", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    if docs.select(quoted(source)).distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)  # else a shuffled join
    keyed = base.withColumn("_null", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    placed = keyed.join(targets, ["source", "_null"]).withColumn("_lane", F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("_lanes")))
    bucket = ["source", "_null", "_class", "_lane"]
    starts = placed.groupBy(bucket).agg(F.sum("_step").alias("_length"))
    line = Window.partitionBy("source", "_null").orderBy("_class", "_lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*bucket, F.coalesce(F.sum("_length").over(line), F.lit(0)).alias("_start"))
    placed = placed.repartition(*bucket)  # else a shuffle by source alone would do for the window
    within = Window.partitionBy(bucket).orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("_sum", F.sum("_step").over(within)).join(starts, bucket)
    end = F.col("_start") + F.col("_sum") + offset(F.when(~F.col("_null"), F.col("source")), seed)
    exact = F.shiftright(end, 24) - F.shiftright(end - F.col("_step"), 24)
    return summed.select(
        "doc_id", "size", "source_size", "target", exact.alias("copies"), F.when(~F.col("_null"), F.col("source")).alias("source"),
        *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry) if c not in ("doc_id", "size", "source_size", "target", "copies", "source")],
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` once per copy, with all its columns.

    Options are those of ``sample_copies``. The copies are found without the texts, and the texts meet
    them in one join on a key of row and text; rows that agree in doc_id, source and text share the copies
    of all of them.
    """
    doc_id, text, source = (options.get(k, k) for k in ("doc_id", "text", "source"))
    key, n, m, k, copy = (fresh(docs.columns, c) for c in ("_key", "_n", "_m", "_k", "_copy"))
    ident = F.xxhash64(F.col(quoted(doc_id)).cast("string"), F.col(quoted(source)).cast("string"), F.col(quoted(text)))
    named = docs.withColumn(key, ident)
    taken = sample_copies(named, carry=(key,), **options).groupBy(key).agg(F.sum("copies").alias(n), F.count(F.lit(1)).alias(m)).filter(F.col(n) > 0)
    # m rows share n copies: the first n % m of them get one more
    joined = named.join(taken, key).withColumn(k, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    share = F.floor(F.col(n) / F.col(m)).cast("long") + F.when(F.col(k) <= F.col(n) % F.col(m), F.lit(1)).otherwise(F.lit(0))
    repeated = joined.withColumn(n, share).filter(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    return repeated.select(*[F.col(quoted(c)) for c in docs.columns])
