import hashlib
import random
import zlib

import pytest

from codequarry.llm import conversations, queries


def brute_force(convs):
    """Nodes of {conversation: [(role, text)]}, by a plain dictionary of prefixes."""
    members = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members.setdefault(tuple(convs[c][:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves, saved, stack = 0, 0, [p]
        while stack:
            x = stack.pop()
            leaves += x not in children
            saved += (len(members[x]) - 1) * (len(x[-1][1].encode()) if x else 0)
            stack += children.get(x, [])
        return leaves, saved

    out = []
    for p, own in members.items():
        leaves, saved = below(p)
        ends = ",".join(str(c) for c in own if len(convs[c]) == len(p))
        out.append((own[0], len(p), members[p[:-1]][0] if p else None, len(own), len(children.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def in_order(rows):
    """The stated order: by turn, null first, ties by the digest of role and text."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out.setdefault(c, []).append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()), (role, text)))
    return {c: [t for _, t in sorted(x)] for c, x in out.items()}


def random_rows(rng, n):
    rows = []
    for c in range(n):
        hot = rng.random() < 0.4
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 21, 40])):
            text = "hot" if hot and turn < 3 else rng.choice(["a", "bé", "c" * 50, None])
            rows.append((c, None if rng.random() < 0.05 else turn, rng.choice(["user", "user", None]), text))
            if rng.random() < 0.05:
                rows.append(rows[-1])
    return [*rows, (None, 0, "user", "no conversation"), (-7, 1, "user", "a"), (-5, 3, "user", "hot")]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(spark, seed):
    rows = random_rows(random.Random(seed), 60)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, name int").repartition(5)
    assert rows_of(conversations.trie(df)) == brute_force(in_order(rows))


def test_rebuilt_conversations_against_brute_force(spark, tmp_path):
    rows = random_rows(random.Random(9), 90)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    own = in_order(rows)
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    assert [] in convs.values()
    assert rows_of(queries.op11_prefix_trie(spark, str(tmp_path))) == brute_force(convs)


def test_many_conversations_end_at_one_node(spark):
    n = 3 * conversations.CHUNK + 5
    df = spark.range(n).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'same' AS text")
    assert rows_of(conversations.trie(df)) == brute_force({c: [("user", "same")] for c in range(n)})


def test_string_ids_and_no_rows(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert conversations.trie(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([("x", 0, "u", "long " * 50_000), ("y", 0, "u", "long " * 50_000), ("y", 1, "u", "")], schema)
    assert rows_of(conversations.trie(df)) == brute_force({"x": [("u", "long " * 50_000)], "y": [("u", "long " * 50_000), ("u", "")]})
