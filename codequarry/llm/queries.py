"""The registered queries of this subpackage and their SQL.

Each query applies its operator, with production parameters, to its whole tables; digest columns are derived here
from what the operator returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversations, decontaminate, language, licenses, lm, mixing, near_dedup, neighbours, quality, secrets, substring_dedup, tokens
from .shared import Scratch

VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
TOKEN_LIMIT = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.sample_copies(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_class")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.assess(_table(spark, sf_dir, "documents"))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & F.col("kept")).alias("kept"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda f: f["base"])
    starts = F.transform(base, lambda f: f["start"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")
    return out.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0)).alias("score"),
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.default_samples(spark))
    out = secrets.scan(_table(spark, sf_dir, "documents"), model)
    n = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.KINDS))
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = language.fit(docs.filter(~held_out(F.col("doc_id"))))
    out = language.identify(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(_table(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.scores(_table(spark, sf_dir, "documents"), order=3)
    return out.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("log_prob", "score")])


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are another's: of c - c % 5 its first h, then c's own after its first h, with h = crc32(c) % 9.

    ``rows``: as of ``conversations.ordered``. Returns (conv_id, pos, key, n_bytes), and every conversation, also those that have no turns left.
    """
    c = F.col("conv_id")
    own = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    plan = own.select("conv_id", (c - c % 5).alias("base"), (F.crc32(c.cast("string").cast("binary")) % 9).alias("h"))
    plan = plan.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    heads = rows.filter(F.col("pos") < 9).withColumnRenamed("conv_id", "base").join(plan, "base").filter(F.col("pos") < F.col("h"))
    tails = rows.join(plan, "conv_id").filter(F.col("pos") >= F.col("h")).withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "pos", "key", "n_bytes"]
    return heads.select(*columns).union(tails.select(*columns)), plan.select("conv_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op11")
    turns, convs = rebuilt(conversations.ordered(_table(spark, sf_dir, "conversations"), scratch))
    return conversations.nodes(scratch.table(turns), scratch.table(convs), scratch)


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY), public_tokenizers.path(PIECE_VOCABULARY))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_near_dedup, op3_quality_rules, op4_token_counts, op5_license_scan, op6_secret_scan, op7_language_id, op8_decontaminate, op9_substring_dedup, op10_lm_scores, op11_prefix_trie, op12_nearest_neighbours, op13_token_alignment)}
