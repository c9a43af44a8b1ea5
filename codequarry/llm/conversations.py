"""A trie of conversation prefixes by prefix doubling.

Turns are named by dense integers, equal turns alike; then blocks of two, four, eight ... turns that start at a multiple
of their length are named by the pair of names of their halves, one round of joins for each power of two. A prefix of d
turns falls into such blocks by the binary digits of d, largest first; its name is that of the pair (name of the prefix
without its last block, name of that block), again one round for each power, from the largest down. Both take rows in
proportion to the turns, and as many rounds as the longest conversation has binary digits; no sequence of turns is ever
collected, and every name is exact but for the digest (SHA-256) that stands for a turn.

Nodes are the groups of equal prefix names. What a node sums over its subtree is summed over its members instead, each
with a running total along its conversation, so no round goes down the trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import numbering
from .shared import Scratch

#: Conversations that end at one node are hashed in chunks of so many.
CHUNK = 512
#: Names of prefixes: (dense name << 6) + the power of their last block; the root's.
ROOT = -1


def ordered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, pos, key, n_bytes) from (conv_id, turn, role, text): turns in order of ``turn``, null first, from position 0.

    A null role or text counts as empty. Turns of a conversation with the same number stand in the order of the
    digest of their role and text; repeated rows are as many turns. Rows without conv_id are left out; other columns
    are ignored.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", key.alias("key"), F.octet_length(text).cast("long").alias("n_bytes"))
    return scratch.table(numbering.numbered(rows, [F.col("turn").asc_nulls_first(), F.col("key").asc()], scratch.table, "pos", by=["conv_id"]).drop("turn"))


def _named(rows: DataFrame, key: list[str], name: str, scratch: Scratch) -> DataFrame:
    """``rows`` with ``name``: a dense integer for each distinct ``key``."""
    return rows.join(numbering.dense_ids(rows.select(*key).distinct(), name, scratch.table), key)


def prefixes(turns: DataFrame, conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, name) for every prefix of every conversation, the empty one included; equal prefixes have the same name.

    ``turns``: (conv_id, pos, key), positions from 0 without gaps; ``conversations``: (conv_id), also those without turns.
    """
    longest = turns.agg(F.max("pos")).first()[0]
    digits = 0 if longest is None else (longest + 1).bit_length()
    blocks: list[DataFrame] = []
    for k in range(digits):
        if k == 0:
            pairs, key = turns.select("conv_id", "pos", "key"), ["key"]
        else:
            half = F.col("pos").bitwiseAND(1 << (k - 1)) != 0
            start = F.shiftleft(F.shiftright("pos", k), k)
            sides = blocks[-1].groupBy("conv_id", start.alias("pos")).agg(F.max(F.when(~half, F.col("name"))).alias("a"), F.max(F.when(half, F.col("name"))).alias("b"))
            pairs, key = sides.filter(F.col("b").isNotNull()), ["a", "b"]
        blocks.append(scratch.table(_named(pairs, key, "name", scratch).select("conv_id", "pos", "name")))
    known = conversations.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).cast("long").alias("name"))
    for k in reversed(range(digits)):
        last = blocks[k].filter(F.col("pos").bitwiseAND(1 << k) == 0).select("conv_id", F.col("pos").alias("depth"), F.col("name").alias("b"))
        pairs = known.withColumnRenamed("name", "a").join(last, ["conv_id", "depth"])
        new = _named(pairs, ["a", "b"], "name", scratch).select("conv_id", (F.col("depth") + (1 << k)).alias("depth"), (F.shiftleft("name", 6) + k).alias("name"))
        known = known.union(scratch.table(new))
    scratch.drop(*blocks)
    return known


def nodes(turns: DataFrame, conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """A row per node of the trie.

    ``turns``: (conv_id, pos, key, n_bytes) as of ``ordered``; ``conversations``: (conv_id), distinct, also those without
    turns, which are members of the root alone. Columns: conv_id, the smallest member; depth; parent_conv_id (root: null);
    n_convs; n_children; n_leaves; saved_tokens, over the subtree the bytes of a node's last text once for every
    member but one; ends_sha256, of the conversations that end at the node, ascending and comma-joined. Without
    conversations there are no nodes.
    """
    known = prefixes(turns, conversations, scratch)
    first = known.groupBy("name").agg(F.min("conv_id").alias("rep"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"))
    first = scratch.table(first)
    size = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "n_bytes")
    own = known.join(first.select("name", "rep"), "name").join(size, ["conv_id", "depth"], "left")
    # every member of a node but the smallest saves the bytes of the node's last text
    own = own.withColumn("saved", F.when(F.col("conv_id") == F.col("rep"), F.lit(0)).otherwise(F.coalesce("n_bytes", F.lit(0))).cast("long")).drop("n_bytes")
    own = scratch.table(numbering.running(scratch.table(own), [F.col("conv_id").asc(), F.col("depth").asc()], ["saved"], scratch.table))

    above = own.select(F.col("conv_id").alias("rep"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("rep").alias("parent_conv_id"))
    placed = scratch.table(first.join(above, ["rep", "depth"], "left"))
    children = placed.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    placed = scratch.table(placed.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))

    # a node without children is the end of all its members: one of them, its smallest, stands for it
    leaves = placed.filter(F.col("n_children") == 0).select(F.col("rep").alias("conv_id"), F.lit(1).cast("long").alias("leaf"))
    whole = own.groupBy("conv_id").agg(F.max("run_saved").alias("all_saved"), F.max_by("name", "depth").alias("last"))
    whole = scratch.table(whole.join(leaves, "conv_id", "left"))
    below = own.join(whole, "conv_id").groupBy("name").agg(F.sum(F.col("all_saved") - F.col("run_saved") + F.col("saved")).alias("saved_tokens"), F.coalesce(F.sum("leaf"), F.lit(0)).cast("long").alias("n_leaves"))
    ends = _ends(whole.select(F.col("last").alias("name"), "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return (
        placed.join(below, "name").join(ends, "name", "left")
        .select(F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(none)).alias("ends_sha256"))
    )


def _ends(last: DataFrame) -> DataFrame:
    """(name, sha): SHA-256 of the node's conversations in order.

    A node at which millions end is cut into chunks by ranges of (name, conv_id), in many tasks; one task then hashes a
    node's chunks as they stream past, since a digest has one order, and never holds more than a chunk.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, ids = b.column("name").to_numpy(), b.column("conv_id")
            cuts = [0, *((name[1:] != name[:-1]).nonzero()[0] + 1).tolist(), len(name)]
            at = [(i, min(i + CHUNK, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False) for i in range(lo, hi, CHUNK)]
            shown = ids.cast(pa.string()).to_pylist()
            starts = pa.array([lo for lo, _ in at], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("name").take(starts), ids.take(starts), pa.array([",".join(shown[lo:hi]) for lo, hi in at], pa.string())], names=["name", "conv_id", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        for b in batches:
            done = []
            for n, ids in zip(b.column("name").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if n != name:
                    if digest:
                        done.append((name, digest.hexdigest()))
                    name, digest = n, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([{"name": n, "sha": s} for n, s in done])
        if digest:
            yield pa.RecordBatch.from_pylist([{"name": name, "sha": digest.hexdigest()}])

    kind = last.schema["conv_id"].dataType.simpleString()
    chunks = last.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(joined, f"name long, conv_id {kind}, ids string")
    return chunks.repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(hashed, "name long, sha string")


def trie(turns: DataFrame) -> DataFrame:
    """``nodes`` of conversations as they are given, by (conv_id, turn, role, text)."""
    scratch = Scratch(turns.sparkSession, "trie")
    rows = ordered(turns, scratch)
    return nodes(rows, rows.select("conv_id").distinct(), scratch)
