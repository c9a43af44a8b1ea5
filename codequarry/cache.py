"""The fact cache (K1-K3, J5, A20, Z1): facts by repository, path and content hash, in Parquet partitioned by version and repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import FORMAT_VERSION


def split_by_cache(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Every file with ``hit``: the cache holds its repository, path and hash in this format. One left join on all keys."""
    have = cached.filter(F.col("format_version") == FORMAT_VERSION).select("repo_key", "path", "content_hash").distinct().withColumn("hit", F.lit(True))
    return files.join(have, ["repo_key", "path", "content_hash"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def counters(split: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(repo_key, files, cached, parsed, failed)."""
    c = split.groupBy("repo_key").agg(F.count(F.lit(1)).alias("files"), F.count_if("hit").alias("cached"), F.count_if(~F.col("hit")).alias("parsed"))
    if failed is None:
        return c.withColumn("failed", F.lit(0).cast("long"))
    return c.join(failed.groupBy("repo_key").agg(F.count(F.lit(1)).alias("failed")), "repo_key", "left").fillna(0)


class FactCache:
    """A directory of facts: (repo_key, path, content_hash, facts...) under ``format_version=…/repo_key=…``."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root, f"{schema}, format_version int"

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.root)
        except Exception as e:  # a cache that was never written is empty
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.schema)
            raise

    def add(self, facts: DataFrame) -> None:
        """Appends; readers take the entry whose hash their file has, so stale entries do no harm."""
        facts.withColumn("format_version", F.lit(FORMAT_VERSION)).write.mode("append").partitionBy("format_version", "repo_key").parquet(self.root)

    def lookup(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(facts of the files that are cached, files that are not)."""
        keys = ["repo_key", "path", "content_hash"]
        cached = self.read().filter(F.col("format_version") == FORMAT_VERSION)
        facts = cached.join(files.select(*keys).distinct(), keys, "left_semi").dropDuplicates(keys)
        return facts, files.join(cached.select(*keys), keys, "left_anti")

    def clear(self, repo_prefix: str = "") -> None:
        """K2, K3: all entries, or those of repositories whose key starts so."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/format_version=*/repo_key={repo_prefix}*")) or []:
            fs.delete(status.getPath(), True)

    def count(self) -> int:
        return self.read().count()
