"""Classes of similar items from their sketches: bucketed candidates, verified links, components.

All pairs of a bucket (items that agree on a sketch) end up in one class or are verified. Every member is first held
against the bucket's first member. In every bucket whose members are then still in several components, all pairs of
different components are verified.

Scale: a bucket's rows are combined in each batch before the shuffle: only the first item of a batch goes to the
bucket, the others stay with it (``combined``), so a bucket however common sends one narrow row a batch. Pairs that are
left are never rows: members are dealt into blocks, members of a batch and a block are one packed row, and each two blocks meet in one
cell, which counts common features of all its pairs at once and verifies only pairs that these counts allow. The members of a bucket's largest component
meet the others only, so what is left of a large class costs little. Cells of a bucket that stays mixed grow with the
square of its blocks, and are dealt out one by one. What is passed on are tables in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch

#: Members of a block, about.
BLOCK = 512
#: Bytes of payloads, each counted once for every bucket, that are packed together.
PACK_BYTES = 32 << 20
#: So many pairs are verified without counting common features first.
FEW = 16
#: Features that are counted together.
_COLUMNS = 8192


@dataclass(frozen=True)
class Rule:
    """``similar`` tells whether two items are; ``possible`` whether they may be, from the number of their common
    features (distinct ones) and of each one's features, over arrays. It may not refuse a pair that is similar.
    ``features`` are made for a list of items at once. Items are given as ``read`` makes them from their binary payload.
    Sizes of similar items differ by ``ratio`` at most."""

    similar: Callable[[object, object], bool]
    features: Callable[[list], list[np.ndarray]]
    possible: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    read: Callable[[bytes], object]
    ratio: float


def combined(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the (key, owner) rows of a batch: the first row of each row's key, and whether the key has several owners."""
    order = np.lexsort((owners, keys))
    k, o = keys[order], owners[order]
    starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))[: k.size]
    n = np.diff(np.append(starts, k.size))
    first, several = np.empty(k.size, np.int64), np.empty(k.size, bool)
    first[order] = np.repeat(order[starts], n)
    several[order] = np.repeat(o[starts] != o[starts + n - 1], n)
    return first, several


def shared_buckets(own: DataFrame, owner: str, *more: str) -> DataFrame:
    """(bucket, owner, *more, first) of the buckets that several owners are in; ``first``: the least (owner, *more)."""
    bucket = Window.partitionBy("bucket")
    rows = own.withColumn("first", F.min(F.struct(owner, *more)).over(bucket)).withColumn("_last", F.max(owner).over(bucket))
    return rows.filter(F.col(f"first.{owner}") != F.col("_last")).drop("_last")


def verified(pairs: DataFrame, payload: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of nodes whose payloads are similar. ``payload``: (node, w)."""
    both = pairs.join(payload.select(F.col("node").alias("a"), F.col("w").alias("wa")), "a").join(payload.select(F.col("node").alias("b"), F.col("w").alias("wb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [rule.similar(rule.read(x.as_py()), rule.read(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "wa", "wb").mapInArrow(run, "a binary, b binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many features each of ``left`` has in common with each of ``right``; features of one item are distinct."""
    out = np.zeros((len(left), len(right)), np.float32)
    ids, inverse = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [x.size for x in (*left, *right)])
    both = np.zeros(ids.size, np.int8)
    both[inverse[owner < len(left)]] |= 1
    both[inverse[owner >= len(left)]] |= 2
    column = np.cumsum(both == 3) - 1
    keep = both[inverse] == 3
    owner, column = owner[keep], column[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if column.size else 0, _COLUMNS):
        s, e = np.searchsorted(column, (lo, lo + _COLUMNS))
        has = np.zeros((len(left) + len(right), _COLUMNS), np.float32)
        has[owner[s:e], column[s:e] - lo] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out


def cell_links(bucket: int, rows: list[tuple], rule: Rule) -> list[tuple[bytes, bytes]]:
    """Links that join all that is similar in a cell. ``rows``: (node, root, block, buckets, w) of one block or two.

    A pair is verified only in the least of the buckets that it shares, and if the cell's links don't join it yet.
    """
    low = min(r[2] for r in rows)
    left = [r for r in rows if r[2] == low]
    right = [r for r in rows if r[2] != low]
    single = not right
    right = right or left
    items = {r[0]: rule.read(r[4]) for r in rows}
    root = [np.array([r[1].hex() for r in side]) for side in (left, right)]
    ask = root[0][:, None] != root[1][None, :]
    if single:
        ask = np.triu(ask, 1)
    common = np.zeros(ask.shape)
    if ask.sum() > FEW:
        of = dict(zip(items, rule.features(list(items.values())), strict=True))
        features = [[of[r[0]] for r in side] for side in (left, right)]
        common = overlaps(*features)
        sizes = [np.array([f.size for f in side]) for side in features]
        ask &= rule.possible(common, sizes[0][:, None], sizes[1][None, :])
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    at = np.argwhere(ask)
    out = []
    for i, j in at[np.argsort(-common[at[:, 0], at[:, 1]], kind="stable")].tolist():
        a, b = left[i], right[j]
        x, y = find(a[1]), find(b[1])
        if x != y and min(set(a[3]) & set(b[3])) == bucket and rule.similar(items[a[0]], items[b[0]]):
            parent[max(x, y)] = min(x, y)
            out.append((min(a[0], b[0]), max(a[0], b[0])))
    return out


def remaining(members: DataFrame, roots: DataFrame, payload: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Links (a, b) by which all similar pairs that share a bucket are joined. ``members``: (bucket, node, n).

    The pair of a bucket of two has been verified already. Larger buckets are split by size first: similar items are of one size class or of neighbouring ones. Only classes that
    have several components, alone or with a neighbour, are left. A member is one row a bucket: it meets its own class and both neighbours from there.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / rule.ratio + 1e-6)) if rule.ratio else F.lit(0).cast("long")
    placed = scratch.table(members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"), size_class.alias("class")))
    cells = scratch.table(_cells(placed))
    n_cells = cells.agg(F.sum("n_cells")).first()[0]
    if not n_cells:
        return placed.select(F.col("node").alias("a"), F.col("root").alias("b")).limit(0)
    is_major, deal = F.coalesce(F.col("root") == F.col("major"), F.lit(False)), F.xxhash64("node")
    block = F.col("base") + F.when(is_major, F.col("others") + F.pmod(deal, "blocks")).otherwise(F.pmod(deal, "others"))
    of = lambda side: F.when(is_major, F.col(f"{side}others")).otherwise(F.col(f"{side}others") + F.col(f"{side}blocks"))
    meets = [c.cast("int").alias(f"{side}{name}") for side in ("", "up.", "down.") for name, c in (("from", F.coalesce(f"{side}base", F.lit(0))), ("n", F.coalesce(of(side), F.lit(0))))]
    dealt = placed.join(cells, ["bucket", "class"]).select("bucket", "node", "root", F.struct("bucket", block.cast("int").alias("block"), *meets).alias("place"))
    # a member meets its payload once; what a batch has for one cell is one row, and only that is dealt out by cells
    places = dealt.groupBy("node").agg(F.first("root").alias("root"), F.collect_list("place").alias("places"))
    packed = places.join(payload, "node").select("node", "root", "places", "w").mapInArrow(_packed, f"bucket long, lo long, hi long, items array<{_ITEM}>")

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        rows = [(x["node"], x["root"], x["block"], x["buckets"], x["w"]) for items in t.column("items").to_pylist() for x in items]
        found = cell_links(key[0].as_py(), rows, rule) if len(rows) > 1 else []
        return pa.table([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return packed.repartition(scratch.tasks(int(n_cells), 200), "bucket", "lo", "hi").groupBy("bucket", "lo", "hi").applyInArrow(meet, "a binary, b binary").distinct()


def _cells(placed: DataFrame) -> DataFrame:
    """(bucket, class, major, base, others, blocks, up, down, n_cells) of the size classes of ``placed`` in which similar pairs may be left.

    A class has ``others`` blocks from ``base`` on, and ``blocks`` more of the bucket's largest component, ``major``; ``up`` and ``down`` are (base, others, blocks) of
    its neighbours. A bucket of few members is one block, whatever their classes.
    """
    bucket = Window.partitionBy("bucket")
    line = bucket.orderBy("class")
    per_root = placed.groupBy("bucket", "class", "root").agg(F.count(F.lit(1)).alias("n"))
    major = per_root.groupBy("bucket", "root").agg(F.sum("n").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("major"), F.sum("n").alias("nodes"), F.count(F.lit(1)).alias("n_roots"))
    major = major.filter("n_roots > 1 and nodes > 2").select("bucket", F.col("major.root").alias("major"))
    of_major = F.sum(F.when(F.col("root") == F.col("major"), F.col("n")).otherwise(0)).alias("of_major")
    by_class = per_root.join(major, "bucket").groupBy("bucket", "class").agg(F.first("major").alias("major"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("n"), of_major)
    up = lambda *names: F.when(F.lead("class").over(line) == F.col("class") + 1, F.lead(F.struct(*names)).over(line))
    down = lambda *names: F.when(F.lag("class").over(line) == F.col("class") - 1, F.lag(F.struct(*names)).over(line))
    by_class = by_class.select("*", up("low", "high").alias("up"), down("low", "high").alias("down"))
    mixed = lambda o: F.col(o).isNotNull() & (F.least("low", f"{o}.low") != F.greatest("high", f"{o}.high"))
    left = by_class.filter((F.col("low") != F.col("high")) | mixed("up") | mixed("down")).drop("up", "down", "low", "high")
    left = left.withColumn("whole", F.sum("n").over(bucket) <= BLOCK)
    others, blocks = F.ceil((F.col("n") - F.col("of_major")) / BLOCK), F.ceil(F.col("of_major") / BLOCK)
    left = left.select("bucket", "class", "whole", F.when(~F.col("whole"), F.col("major")).alias("major"), F.when(F.col("whole"), 1).otherwise(others).alias("others"), F.when(F.col("whole"), 0).otherwise(blocks).alias("blocks"))
    before = F.sum(F.col("others") + F.col("blocks")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    left = left.withColumn("base", F.when(F.col("whole"), 0).otherwise(F.coalesce(before, F.lit(0))))
    left = left.select("*", *(F.when(~F.col("whole"), side("base", "others", "blocks")).alias(name) for side, name in ((up, "up"), (down, "down"))))
    across = F.coalesce(F.col("others") * (F.col("up.others") + F.col("up.blocks")) + F.col("blocks") * F.col("up.others"), F.lit(0))
    own = F.col("others") * (F.col("others") + 1) / 2 + F.col("others") * F.col("blocks")
    return left.select("bucket", "class", "major", "base", "others", "blocks", "up", "down", (own + across).alias("n_cells"))


_ITEM = "struct<node:binary,root:binary,block:bigint,buckets:array<bigint>,w:binary>"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, lo, hi, items) from (node, root, places, w): the items of a run of rows that meet in one cell are one row.

    A place has its bucket, its block, and (first, number) of the blocks that it meets in its own size class and in both neighbours.
    """
    for whole in batches:
        lists = whole.column("places")
        n_places, flat = lists.value_lengths().to_numpy(), lists.flatten()
        bucket, block = (flat.field(i).to_numpy().astype(np.int64) for i in range(2))
        first, meets = (np.stack([flat.field(i).to_numpy() for i in range(at, 8, 2)], axis=1).ravel().astype(np.int64) for at in (2, 3))
        row = np.repeat(np.arange(whole.num_rows), n_places)
        buckets = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_places))).astype(np.int32)), pa.array(bucket))
        stretch = np.repeat(np.arange(meets.size), meets)
        place, other = stretch // 3, first[stretch] + np.arange(stretch.size) - np.repeat(np.cumsum(meets) - meets, meets)
        size = pa.compute.binary_length(whole.column("w")).to_numpy() + 64 + 8 * n_places
        run = np.cumsum(size[row[place]]) // PACK_BYTES
        bounds = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1], [True]))) if run.size else [0]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            p, o = place[lo:hi], other[lo:hi]
            low, high = np.minimum(block[p], o), np.maximum(block[p], o)
            order = np.lexsort((high, low, bucket[p]))
            key = [x[order] for x in (bucket[p], low, high)]
            starts = np.flatnonzero(np.concatenate(([True], np.any([np.diff(x) != 0 for x in key], axis=0))))
            at = pa.array(row[p[order]])
            items = pa.StructArray.from_arrays([whole.column("node").take(at), whole.column("root").take(at), pa.array(block[p[order]]), buckets.take(at), whole.column("w").take(at)], names=["node", "root", "block", "buckets", "w"])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[starts]) for x in key), pa.ListArray.from_arrays(pa.array(np.append(starts, order.size).astype(np.int32)), items)], names=["bucket", "lo", "hi", "items"])


def link_classes(members: DataFrame, payload: DataFrame, rule: Rule, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, root) of all nodes with a link, and the links (a, b) themselves.

    ``members``: (bucket, node, n, first (node, n)), written; ``payload``: (node, w) of all nodes that a bucket has beside others.
    """
    fits = (F.col("n") >= rule.ratio * F.col("first.n") - 1e-6) & (F.col("first.n") >= rule.ratio * F.col("n") - 1e-6)
    pairs = members.filter((F.col("node") != F.col("first.node")) & fits).select(F.col("first.node").alias("a"), F.col("node").alias("b"))
    pairs = scratch.table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    size = scratch.tasks(pairs.count(), 4000)
    links = scratch.table(verified(pairs, payload, rule), size)
    roots = components(links, scratch, tasks=size)
    found = scratch.table(remaining(members.select("bucket", "node", "n").distinct(), roots, payload, rule, scratch), size)
    if found.isEmpty():
        return roots, links
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found), scratch, tasks=size), links.union(found)
