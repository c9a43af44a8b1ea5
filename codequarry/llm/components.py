"""Connected components of a link table, by alternating large-star and small-star steps.

Each step joins nothing: it groups the links by one end. A node with very many links is grouped by minimum with
combining on the map side and by one equi-join, whose skew adaptive execution can split; no list of neighbours is
ever built. The number of steps grows with the logarithm of the component size. Every round is a table in the
shared folder, so a lost executor costs one round at most; only the number of changed links reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", tasks: int | None = None) -> DataFrame:
    """(node, root) for every node of ``links``; ``root`` is the least node that it is linked to, over any steps.

    Self links, repeated links and nulls at either end are ignored. Without links the result is empty.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now = scratch.table(edges, tasks)
    seen = _digest(now)
    while True:
        size = scratch.tasks(seen[0])
        large = _star(now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v"), F.col("u"))), upwards=True)
        large = scratch.table(large.select(F.greatest("p", "q").alias("x"), F.least("p", "q").alias("y")), size)
        small = _star(large, upwards=False)
        after = scratch.table(small.select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct(), size)
        scratch.drop(now, large)
        # done when a round leaves the links as they were: every node has one link, to its root
        before, seen, now = seen, _digest(after), after
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, upwards: bool) -> DataFrame:
    """Links (p, q) from neighbours of x to the least of x and its neighbours.

    Large star (``upwards``): the neighbours greater than x. Small star: those less than x, as all given are, and x.
    """
    least = pairs.groupBy("x").agg(F.min("y").alias("m"))
    joined = pairs.join(least, "x").withColumn("m", F.least("x", "m"))
    if upwards:
        return joined.filter(F.col("y") > F.col("x")).select(F.col("y").alias("p"), F.col("m").alias("q")).filter(F.col("p") != F.col("q"))
    own = least.select(F.col("x").alias("p"), F.least("x", "m").alias("q"))
    return joined.select(F.col("y").alias("p"), F.col("m").alias("q")).union(own).filter(F.col("p") != F.col("q"))
