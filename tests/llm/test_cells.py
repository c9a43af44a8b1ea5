"""Cells of mixed buckets against brute force."""

import itertools
import random

import numpy as np
import pytest

from codequarry.llm import linking, near_dedup
from codequarry.llm.shared import Scratch


@pytest.mark.parametrize("block", [4, 512])
def test_members_meet_once_and_all_similar_are_joined(spark, monkeypatch, block):
    monkeypatch.setattr(linking, "BLOCK", block)
    rng = random.Random(5)
    items = {}
    for family in range(6):
        text = [rng.randrange(1 << 30) for _ in range(rng.choice((20, 24, 30, 38)))]
        for _ in range(8):
            changed = list(text)
            for _ in range(rng.randrange(4)):
                changed[rng.randrange(len(changed))] = rng.randrange(1 << 30)
            changed += [rng.randrange(1 << 30) for _ in range(rng.randrange(4))]
            items[f"{family}-{len(items):03}".encode()] = np.array(changed, np.uint32)
    rows = [(b, bytearray(k), int(w.size)) for k, w in items.items() for b in (1, 2)]
    scratch = Scratch(spark, "cells")
    members = scratch.table(spark.createDataFrame(rows, "bucket long, node binary, n int"))
    roots = spark.createDataFrame([], "node binary, root binary")
    payload = spark.createDataFrame([(bytearray(k), bytearray(w.tobytes())) for k, w in items.items()], "node binary, w binary")
    met = []
    whole = linking._cells
    monkeypatch.setattr(linking, "_cells", lambda placed: met.append(placed.join(cells := whole(placed), ["bucket", "class"]).count()) or cells)
    found = [(bytes(a), bytes(b)) for a, b in linking.remaining(members, roots, payload, near_dedup.rule(), scratch).collect()]
    assert met[0] <= len(rows)  # each member is one row a bucket, whichever size classes it meets
    parent = {k: k for k in items}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in found:
        assert near_dedup.similar(items[a], items[b])
        parent[find(a)] = find(b)
    for a, b in itertools.combinations(items, 2):
        if near_dedup.similar(items[a], items[b]):
            assert find(a) == find(b)
