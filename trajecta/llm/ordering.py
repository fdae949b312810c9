"""Places of rows in the order of their key, without a window over a whole key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def number_runs(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` written in the order of ``key`` and ``order``, with ``part`` and ``nth``.

    Rows are range partitioned, so a key with very many rows lies in many parts: parts ascend
    with the order, and ``nth`` counts (from 0) the key's rows in the part. Rows that are
    alike in all these columns are dealt at random among neighbouring parts, so they must be
    interchangeable. ``key`` holds no nulls; in ``order`` nulls come first.
    """
    rows = rows.withColumn("salt", F.rand(11))
    schema = rows.drop("salt").schema.add("part", "long").add("nth", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(key)
            new = np.ones(b.num_rows, dtype=bool)
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[0] = keys[0].as_py() != last
            at = np.arange(b.num_rows)
            first = np.where(new, at, -1)
            first = np.maximum.accumulate(first)
            nth = np.where(first < 0, at + seen, at - first)
            last, seen = keys[-1].as_py(), int(nth[-1]) + 1
            own = [c for n, c in zip(b.schema.names, b.columns, strict=True) if n != "salt"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(b.num_rows, part), pa.int64()), pa.array(nth, pa.int64())], names=schema.names)

    by = [key, *order, "salt"]
    return materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema), name)


def with_index(rows: DataFrame, key: str, order: list[str], name: str) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` with ``idx``, the place (from 0) in the order of their key, and ``n``, the key's rows.

    Only counts by part and key meet in a window: a row for each part of a key. They are
    written, so that the join that brings them back goes by their true size. The second
    value lists the tables to ``discard`` once the result is written.
    """
    numbered = number_runs(rows, key, order, name)
    counts = numbered.groupBy("part", key).agg((F.max("nth") + 1).alias("c"))
    own, before = Window.partitionBy(key), Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.select("part", key, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(own).alias("n"))
    spans = materialize(spans, f"{name}-spans")
    placed = numbered.join(spans, ["part", key]).withColumn("idx", F.col("before") + F.col("nth")).drop("part", "nth", "before")
    return placed, [numbered, spans]
