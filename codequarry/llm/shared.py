"""What the operators of this subpackage share: expression helpers and tables in the shared folder."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A word of letters and digits: ASCII ones and everything beyond ASCII.
ALNUM_WORD = r"[0-9A-Za-z\P{ASCII}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once per row however often ``body`` mentions it.

    Catalyst may inline a projected column into every place that uses it; a lambda variable is a
    binding that it cannot inline.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column, pattern: str = WORD) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that no column in ``taken`` has, whatever its case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits for (doc_id, text), nulls told apart: tells rows apart that repeat a doc_id with another text."""
    given = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.md5(F.encode(F.concat(given(doc_id.cast("string")), given(text)), "utf-8")))


#: Rows of a table up to which the tags of some of its keys are sent to all tasks: about a byte for each row.
TAGGED_ROWS = 1 << 26


def tags(keys: DataFrame, n_rows: int) -> DataFrame:
    """(block, tags, but): 16 bits of each key of ``keys`` (key), by block, for a table of ``n_rows`` rows. ``but`` is empty."""
    named = keys.select(*_block_and_tag(F.col("key"), n_rows))
    return named.groupBy("block").agg(F.collect_set("tag").alias("tags")).withColumn("but", F.array().cast("array<binary>"))


def exact_tags(keys: DataFrame, every: DataFrame, n_rows: int) -> DataFrame:
    """``tags`` with the keys of ``every`` that have a tag, but aren't in ``keys``, as ``but``: of ``every``, only ``keys`` are tagged then."""
    rough = tags(keys, n_rows)
    others = tagged(every.select("key"), "key", rough, n_rows).join(keys.select("key"), "key", "left_anti")
    but = others.groupBy(_block_and_tag(F.col("key"), n_rows)[0]).agg(F.collect_set("key").alias("others"))
    return rough.drop("but").join(but, "block", "left").select("block", "tags", F.coalesce("others", F.array().cast("array<binary>")).alias("but"))


def tagged(rows: DataFrame, key: str, tags: DataFrame, n_rows: int, how: str = "left_semi") -> DataFrame:
    """The ``rows`` whose ``key`` has a tag (``left_anti``: has none). They aren't moved: the tags go to them."""
    block, tag = _block_and_tag(F.col(quoted(key)), n_rows)
    names = {c: fresh(rows.columns, f"_{c}") for c in ("block", "tags", "but")}
    there = F.broadcast(tags.select(*[F.col(c).alias(name) for c, name in names.items()]))
    has = F.array_contains(F.col(names["tags"]), tag) & ~F.array_contains(F.col(names["but"]), F.col(quoted(key)))
    return rows.join(there, (block == F.col(names["block"])) & has, how)


def _block_and_tag(key: Column, n_rows: int) -> tuple[Column, Column]:
    h = F.xxhash64(key)
    return F.pmod(h, F.lit(n_rows // 128 + 1)).alias("block"), F.shiftright(h, 48).cast("short").alias("tag")


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Tables of one run in the shared folder; they survive lost executors and cut lineage."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0
        atexit.register(self._at_exit)

    def tasks(self, rows: int, each: int = 20_000) -> int:
        """How many tasks suit so many rows: two for each core at least, more as the rows grow."""
        return max(rows // each, 2 * self.spark.sparkContext.defaultParallelism)

    def table(self, df: DataFrame, tasks: int | None = None) -> DataFrame:
        """``df`` written once as Parquet and read again. ``tasks``: the most tasks, and files, that its rows are worth."""
        self.n += 1
        if tasks:
            df = df.coalesce(tasks)
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t._scratch_path)

    def _at_exit(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # the session may have ended before
            pass
