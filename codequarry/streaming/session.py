"""Sessions of expanded slices: eviction and ledger in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_of_address

# Context window, slice budget and rounds by model tier.
TIERS = {"small": (8_000, 600, 2), "medium": (32_000, 1_200, 3), "large": (128_000, 2_400, 4)}


def eviction(slices: DataFrame, cap: int) -> DataFrame:
    """Every slice with ``dropped``: while a session's kept tokens are over ``cap``, the slice of the least hits * 1000 + round
    goes, never the newest (the last by ``ord``). A cap of 0 or less keeps all.

    A running sum in that order tells how much is gone before each slice: it goes if what is left then is still over.
    """
    if cap <= 0:
        return slices.withColumn("dropped", F.lit(False))
    session = Window.partitionBy("session")
    newest = F.col("ord") == F.max("ord").over(session)
    order = Window.partitionBy("session", "newest").orderBy(F.col("hits") * 1000 + F.col("round"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    s = slices.withColumn("newest", newest).withColumn("total", F.sum("tokens").over(session))
    gone = F.coalesce(F.sum("tokens").over(order), F.lit(0))
    return s.withColumn("dropped", ~F.col("newest") & (F.col("total") - gone > cap)).drop("newest", "total")


def eviction_totals(planned: DataFrame) -> DataFrame:
    """A19."""
    part = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0))
    d = F.col("dropped")
    return planned.groupBy("session").agg(F.count(F.lit(1)).alias("slices"), part(~d, F.lit(1)).alias("kept"), part(d, F.lit(1)).alias("dropped"), part(~d, F.col("tokens")).alias("kept_tokens"), part(d, F.col("tokens")).alias("dropped_tokens"))


def naive_cost(address: Column, tokens: Column, file_tokens: Column) -> Column:
    """What a slice's whole file would cost; null for directories and indexes."""
    file = file_of_address(address)
    return F.when(~file.endswith("/") & ~address.startswith("index:"), F.coalesce(file_tokens, tokens * 4))


def ledger(planned: DataFrame, pack_tokens: int = 0) -> DataFrame:
    """Totals of each session, the cost of reading each file whole once, and their ratio to one decimal."""
    t = eviction_totals(planned)
    c = planned.withColumn("file", file_of_address(F.col("address"))).withColumn("cost", naive_cost(F.col("address"), F.col("tokens"), F.col("file_tokens")))
    naive = c.filter("cost IS NOT NULL").groupBy("session", "file").agg(F.max("cost").alias("cost")).groupBy("session").agg(F.sum("cost").alias("naive_tokens"))
    j = t.join(naive, "session", "left").withColumn("naive_tokens", F.coalesce("naive_tokens", F.lit(0))).withColumn("tokens", F.col("kept_tokens") + pack_tokens)
    ratio = F.when((F.col("naive_tokens") > 0) & (F.col("tokens") > 0), F.floor(F.col("naive_tokens") / F.col("tokens") * 10 + 0.5) / 10).otherwise(F.lit(0.0))
    return j.select("session", "slices", "kept", "dropped", "kept_tokens", "dropped_tokens", "tokens", "naive_tokens", ratio.alias("ratio"))
