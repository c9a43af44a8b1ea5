"""Sessions that ask for slices: the rule by hand, the stream across a restart, the table."""

import random

import pytest

from codequarry.streaming import expansion

SLICES = [("a:1", "ok", 10, 100, None), ("b:1", "ok", 20, None, None), ("c/", "digest", 30, 7, None), ("d:1", "ambiguous", 5, 5, None), ("e:1", "invalid", None, None, "read-failed")]
SLICE = "address string, kind string, tokens long, file_tokens long, reason string"
ANSWER = "session string, seq long, text string"


def by_hand(texts, max_rounds, cap):
    """A session played from its answers' texts, with lists as a person would keep them."""
    known = {s[0]: s for s in SLICES}
    out, fetched, gone = [], [], set()
    for n, t in enumerate(texts):
        asked = [line.split()[1] for line in (t or "").split("\n") if line.startswith("@@expand ") and len(line.split()) == 2]
        have = {f["address"]: f for f in fetched}
        for x in asked:
            if x in have:
                have[x]["hits"] += 1
                out.append((n, "hit", x, None, None, None, None))
        new = [x for x in asked if x not in have]
        if not new or n == max_rounds:
            out.append((n, "end", None, None, None, None, None))
            break
        _, kind, tokens, whole, why = known.get(new[0], (new[0], "invalid", None, None, "not-found"))
        ok = kind in ("ok", "digest")
        fetched.append({"address": new[0], "tokens": tokens if ok else 0, "hits": 0, "round": n})
        out.append((n, "slice", new[0], ok, tokens if ok else 0, whole if kind == "ok" else None, None if ok else {"ambiguous": "ambiguous"}.get(kind, why)))
        if cap > 0:
            total, rest = sum(f["tokens"] for f in fetched), sorted(fetched[:-1], key=lambda f: f["hits"] * 1000 + f["round"])
            while total > cap and rest:
                f = rest.pop(0)
                total -= f["tokens"]
                if f["address"] not in gone:
                    gone.add(f["address"])
                    out.append((n, "evict", f["address"], None, None, None, None))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple(map(str, r)))


def sessions(seed):
    rng = random.Random(seed)
    say = lambda: "\n".join(rng.choice(["words", "@@expand no address", *[f"@@expand {a}" for a in ("a:1", "b:1", "c/", "d:1", "e:1", "x:9")]]) for _ in range(rng.randint(0, 4)))
    out = [(f"s{i}", seq, rng.choice([say(), say(), say(), None])) for i in range(40) for seq in sorted(rng.sample(range(100), rng.randint(1, 6)))]
    return out


def wanted(data, max_rounds, cap):
    by: dict = {}
    for s, seq, t in data:
        by.setdefault(s, []).append((seq, t))
    return sorted(((s, *e) for s, turns in by.items() for e in by_hand([t for _, t in sorted(turns, key=lambda x: x[0])], max_rounds, cap)), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize(("max_rounds", "cap"), [(3, 0), (3, 35), (1, 10), (5, 25)])
def test_table(spark, max_rounds, cap):
    data = sessions(max_rounds * 100 + cap)
    df = spark.createDataFrame([*data, data[0], ("s0", None, "@@expand a:1")], ANSWER)
    got = rows(expansion.expand(df, spark.createDataFrame(SLICES, SLICE), max_rounds, cap))
    assert got == wanted(data, max_rounds, cap)


def test_odd_rows(spark):
    slices = spark.createDataFrame(SLICES, SLICE)
    none = expansion.expand(spark.createDataFrame([], ANSWER), slices)
    assert none.collect() == [] and expansion.ledgers(none).collect() == []
    got = rows(expansion.expand(spark.createDataFrame([(None, 1, "@@expand a:1"), (None, 2, None)], ANSWER), slices))
    assert got == [(None, 0, "slice", "a:1", True, 10, 100, None), (None, 1, "end", None, None, None, None, None)]
    long = "word\n" * 200_000 + "@@expand b:1"
    assert expansion.expand(spark.createDataFrame([("s", 1, long)], ANSWER), slices).first()["address"] == "b:1"


def test_ledgers(spark):
    data = [("s", 0, "@@expand a:1"), ("s", 1, "@@expand b:1\n@@expand a:1"), ("s", 2, "@@expand zz:1\n@@expand a:1"), ("s", 3, "done")]
    events = expansion.expand(spark.createDataFrame(data, ANSWER), spark.createDataFrame(SLICES, SLICE))
    got = {r["address"]: (r["ok"], r["hits"], r["tokens"]) for r in expansion.slices_of(events).collect()}
    assert got == {"a:1": (True, 2, 10), "b:1": (True, 0, 20), "zz:1": (False, 0, 0)}
    r = expansion.ledgers(events, pack_tokens=10).first()
    assert (r["slices"], r["kept_tokens"], r["tokens"], r["naive_tokens"], r["ratio"]) == (3, 30, 40, 180, 4.5)


def test_stream_across_a_restart(spark, tmp_path):
    """Answers come in three files; the query is stopped and started between them, and the last file holds earlier answers again."""
    data = sessions(7)
    early, late = [x for x in data if x[1] < 50], [x for x in data if x[1] >= 50]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, part in enumerate((early, late, early)):
            spark.createDataFrame(part, ANSWER).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(ANSWER).parquet(str(tmp_path / "in"))
            q = expansion.expand_stream(stream, spark.createDataFrame(SLICES, SLICE), 3, 35)
            q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = rows(spark.read.parquet(str(tmp_path / "out")).select(*[c.split()[0] for c in expansion.EVENTS.split(", ")]))
    assert got == wanted(data, 3, 35)
