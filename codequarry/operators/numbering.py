"""Row numbers and running totals over a whole table in a declared order, with no window over all rows or over one group.

Rows are dealt by ranges of the order, so a group that holds a third of them is spread over many tasks. Each task numbers
and sums its own rows; one row per task then gives the offsets, and those are few however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: monotonically_increasing_id() has the task above these bits and the row below.
_BITS = 33
Write = Callable[[DataFrame], DataFrame]


def _offsets(t: DataFrame, part: Column, sums: dict[str, Column]) -> DataFrame:
    """A row per task: what all tasks before it hold."""
    per_task = t.groupBy(part.alias("_part")).agg(*[v.alias(k) for k, v in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_task.select("_part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums])


def dense_ids(df: DataFrame, name: str, write: Write) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... without gaps, in no particular order. The rows are written once, so the numbers hold."""
    t = write(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", _BITS)
    first = _offsets(t, part, {"_first": F.count(F.lit(1))})
    return t.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_at").bitwiseAND((1 << _BITS) - 1)).drop("_part", "_first", "_at")


def numbered(df: DataFrame, order: Sequence[Column], write: Write, name: str = "row", by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``name``: the row's number from 0 in ``order``, within its ``by`` group if that is given.

    ``order`` must tell all rows apart, else ties are numbered in any order. Null keys of ``by`` are a group.
    """
    order = [*[F.col(c).asc_nulls_first() for c in by], *order]
    out = dense_ids(df.repartitionByRange(*order).sortWithinPartitions(*order), name, write)
    if not by:
        return out
    first = out.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.min(name).alias("_least"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    return out.join(first, same).withColumn(name, F.col(name) - F.col("_least")).drop("_least", *[f"_by{i}" for i in range(len(by))])


def running(df: DataFrame, order: Sequence[Column], sums: Iterable[str], write: Write) -> DataFrame:
    """``df`` with ``run_<c>`` for each long column ``c`` of ``sums``: the total of ``c`` (nulls count as 0) from the first row of ``order`` to this one."""
    sums = list(sums)
    columns = [f"run_{c}" for c in sums]
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.LongType()) for c in columns], T.StructField("_part", T.IntegerType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for b in batches:
            if b.num_rows:
                new = []
                for c in sums:
                    total = np.cumsum(b.column(c).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) + so_far[c]
                    so_far[c] = int(total[-1])
                    new.append(pa.array(total))
                yield pa.RecordBatch.from_arrays([*b.columns, *new, pa.array(np.full(b.num_rows, part, np.int32))], names=[*b.schema.names, *columns, "_part"])

    t = write(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, schema))
    before = _offsets(t, F.col("_part"), {f"_before_{c}": F.sum(c) for c in sums})
    return t.join(F.broadcast(before), "_part").withColumns({f"run_{c}": F.col(f"run_{c}") + F.col(f"_before_{c}") for c in sums}).drop("_part", *[f"_before_{c}" for c in sums])
