"""The stages of the pipeline on odd rows: nulls, empty texts, repeated rows, clashing columns, no rows at all."""

from collections import Counter

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _lang string, _score string, _hit string, _spans string, size string"
ENGLISH = "the cat sat on the mat and the dog looked at it for a long while before it went home again"


def docs(spark):
    rows = [(1, ENGLISH, "en", "a"), (1, ENGLISH, "en", "a"), (2, None, None, None), (None, "", "en", None), (None, ENGLISH + " number two", None, "b"), (3, "der Hund und die Katze gehen nach Hause weil es regnet", "de", None), (4, "1 2 3", "en", "a"), (5, "word " * 20000, "en", "b")]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", None, "y", "z", None) for i, t, lang, s in rows], SCHEMA)


def test_stages_on_odd_rows(spark, sf):
    given = docs(spark)
    n = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, sf)
        got = out.collect()
        n[name] = len(got)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == given.columns, name
            assert {(r["doc_id"], r["_lang"], r["_hit"]) for r in got} <= {(r["doc_id"], r["_lang"], r["_hit"]) for r in given.collect()}, name
        if name == "language_id":
            assert all(r["text"] not in (None, "", "1 2 3") for r in got)
        if name == "minhash_near_dedup":
            assert sum(r["doc_id"] == 1 for r in got) == 1
    assert n["benchmark_decontamination"] == n["secret_scan"] == 8, n


def test_stages_on_no_rows(spark, sf):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark).limit(0), sf).count() == 0, name


def test_repeated_rows_and_rows_without_words(spark, sf):
    given = spark.createDataFrame([(1, None, None), (1, None, None), (2, "", "a"), (2, "", "a"), (3, " \n", "a"), (4, ENGLISH, "a"), (4, ENGLISH, "a"), (5, ENGLISH + " number two and more", None)], "doc_id long, text string, source string")
    stages = dict(corpus_pipeline.STAGES)
    assert sorted(r["doc_id"] for r in stages["minhash_near_dedup"](spark, given, sf).collect()) in ([1, 2, 3, 4], [1, 2, 3, 4, 5])
    assert sum(r["text"] is None for r in stages["secret_scan"](spark, given, sf).collect()) == 2
    assert sorted(r["doc_id"] for r in stages["benchmark_decontamination"](spark, given, sf).collect()) == [1, 1, 2, 2, 3, 4, 4, 5]
    copies = Counter(r["doc_id"] for r in stages["mix_sources"](spark, given, sf).collect())
    assert set(copies) <= {1, 2, 3, 4, 5} and copies == Counter(r["doc_id"] for r in stages["mix_sources"](spark, given, sf).collect())
    rows = Counter(r["doc_id"] for r in given.collect())
    assert all(copies[i] <= 3 * n for i, n in rows.items())
