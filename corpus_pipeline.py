"""A corpus pipeline of five stages over ``documents``; each works on all that the one before it kept.

Every stage takes nulls in any column, texts of any length, repeated rows, further columns of any name, and tables without
rows, which give tables without rows. What becomes of such rows is stated stage by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import decontaminate, language, mixing, near_dedup, secrets
from codequarry.llm.shared import Scratch, fresh, quoted

#: Documents whose language score is below this are rejected, as are those without letters.
LEAST_LANGUAGE_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that ``docs`` is labelled with; the others go, as do null texts and those without letters. Repeated rows stay."""
    pred, score = fresh(docs.columns, "_lang"), fresh(docs.columns, "_score")
    out = language.identify(docs, language.fit(docs), carry=tuple(docs.columns), names=(pred, score))
    return out.filter((F.col(pred) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*[F.col(quoted(c)) for c in docs.columns])


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; of repeated rows one stays, null and empty texts included."""
    return near_dedup.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window; null and empty texts have none. Repeated rows stay."""
    out = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=tuple(docs.columns), names=tuple(fresh(docs.columns, c) for c in ("_words", "_hit", "_items")))
    return out.filter(F.col(fresh(docs.columns, "_hit")) == 0).select(*[F.col(quoted(c)) for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret, and ``n_chars`` brought up to date. Null texts stay null."""
    model = secrets.train(secrets.default_samples(spark))
    spans = fresh(docs.columns, "_spans")
    found = secrets.scan(docs, model, carry=tuple(docs.columns), name=spans)
    clean = secrets.redact(F.col("text"), F.col(spans))
    changed = {"text": clean, "n_chars": F.when(F.size(F.col(spans)) > 0, F.length(clean)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if changed.get(c) is not None else F.col(quoted(c)) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once per copy that the mix takes; those without words are taken at their source's rate as well. A null source is one of its own, and a source without any words gives none."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
]

#: Near-dedup by sketches and alignment can't be expressed in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
