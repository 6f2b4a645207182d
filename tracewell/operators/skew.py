"""A few keys holding most records: per-key results by range partitions that split heavy keys, then stitching.

Rows are range-partitioned on (key, order columns) with Spark's sampled quantiles as bounds. As the order columns belong to the bounds,
a key with a third of all rows is cut into as many slices as its share asks for. Each task folds its sorted slice into one partial state per
key; the few states of a key (at most one per partition) are then stitched in order, which also yields what lies across a boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.runtime import Scratch, by_size

STATE = "key string, part int, n long, total long, measured long, first long, last long, gap long"


def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, at, value) into partial states; a state is carried over batches and let go when its key ends."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    open_: tuple | None = None  # key, n, total, measured, first, last, gap
    for batch in it:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        at, value = batch.column(1), batch.column(2)
        has_at, has = np.asarray(pc.is_valid(at)), np.asarray(pc.is_valid(value)).astype(np.int64)
        at, value = np.asarray(pc.fill_null(at, 0)), np.asarray(pc.fill_null(value, 0))
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        n, total, measured = ends - starts, np.add.reduceat(value * has, starts), np.add.reduceat(has, starts)
        done = []
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            t = at[a:b][has_at[a:b]]  # nulls come first in the order; they are rows without a place in time
            first, last, gap = (int(t[0]), int(t[-1]), int(np.diff(t).max()) if len(t) > 1 else None) if len(t) else (None, None, None)
            state = (key[a], int(n[i]), int(total[i]), int(measured[i]), first, last, gap)
            if open_ is not None and open_[0] == state[0]:
                across = state[4] - open_[5] if state[4] is not None and open_[5] is not None else None
                gaps = [x for x in (open_[6], state[6], across) if x is not None]
                open_ = (state[0], open_[1] + state[1], open_[2] + state[2], open_[3] + state[3], state[4] if open_[4] is None else open_[4], open_[5] if state[5] is None else state[5], max(gaps) if gaps else None)
            else:
                if open_ is not None:
                    done.append(open_)
                open_ = state
        if done:
            yield states(done, part)
    if open_ is not None:
        yield states([open_], part)


def states(done: list[tuple], part: int) -> pa.RecordBatch:
    k, n, total, measured, first, last, gap = zip(*done)
    long = lambda x: pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array([part] * len(k), pa.int32()), long(n), long(total), long(measured), long(first), long(last), long(gap)], ["key", "part", "n", "total", "measured", "first", "last", "gap"])


def split_totals(df: DataFrame, key: str, at: str, value: str, unique: str, slices: int | None = None, costly: bool = False) -> DataFrame:
    """Per key: ``n`` rows, ``total`` and ``measured`` (sum and count of the long ``value``), ``first``, ``last`` and the longest ``gap`` of ``at`` (microseconds).

    ``unique`` breaks ties of ``at``, so that equal rows can be split too. Rows with a null or blank key belong to no key and are left out; null times and
    values count as rows only. An empty table gives no row. ``slices``: partitions, by size unless given. Sums are of integers: no order changes them. Range
    partitioning reads its input twice, to sample it and to send it; where that is ``costly``, the narrow rows are written to the shared folder first.
    """
    rows = df.select(F.trim(F.col(key)).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(value).cast("long").alias("value"), F.col(unique).alias("u")).where("key <> ''")
    if costly:
        rows = Scratch(df.sparkSession, "skew").cut(rows, "rows")
    slices = slices or by_size(rows if costly else df, 32 << 20, least=int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(slices, "key", "at", "u").sortWithinPartitions("key", "at", "u").select("key", "at", "value")
    return stitch(ranged.mapInArrow(fold, STATE))


def stitch(partial: DataFrame) -> DataFrame:
    """Partial states (at most one per key and partition) to one row per key; the gap over a boundary comes from the neighbours' ends."""
    ordered = Window.partitionBy("key").orderBy("part")
    before = F.last("last", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    return partial.withColumn("across", F.col("first") - before).groupBy("key").agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.sum("measured").alias("measured"),
        F.timestamp_micros(F.min("first")).cast("timestamp_ntz").alias("first_at"),
        F.timestamp_micros(F.max("last")).cast("timestamp_ntz").alias("last_at"),
        F.greatest(F.max("gap"), F.max("across")).alias("longest_gap_us"),
    )
