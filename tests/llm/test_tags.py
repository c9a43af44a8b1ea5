"""Rows chosen by tags of their keys."""

import pytest
from pyspark.sql import functions as F

from codequarry.llm import near_dedup, shared


def _docs(spark):
    base = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(12)]
    texts = [*base, *base[:5], *(t + " more" for t in base[:3]), "", None, "..."]
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(3, base[3]), (40, ""), (11, base[11])], "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("collide", [False, True])
def test_dedup_is_exact_whatever_tags_collide(spark, monkeypatch, collide):
    if collide:
        monkeypatch.setattr(shared, "_block_and_tag", lambda key, n: (F.lit(0).cast("long").alias("block"), (F.length(key) * 0).cast("short").alias("tag")))
    got = sorted(r[0] for r in near_dedup.deduplicate(_docs(spark)).collect())
    monkeypatch.setattr(near_dedup, "TAGGED_ROWS", 0)
    assert got == [*range(12), 20, 21, 22, 40]
    assert got == sorted(r[0] for r in near_dedup.deduplicate(_docs(spark)).collect())


def test_dedup_does_not_move_texts(spark):
    docs = _docs(spark).filter("doc_id != 3 and doc_id != 11")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = near_dedup.deduplicate(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
