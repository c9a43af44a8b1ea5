"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none, by application; the setting itself can't be changed in a running session.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the context's checkpoint folder; where both are unset and Spark is local, as in tests, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else _OWN.get(spark.sparkContext.applicationId)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="codequarry-")
    return found.rstrip("/")


class Tables:
    """Tables of one run: they cut lineage and outlive lost executors; the folder goes with the process."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        atexit.register(self._clear)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, table: DataFrame) -> None:
        if path := self.paths.pop(id(table), None):
            self._delete(path)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may have ended before
            pass
