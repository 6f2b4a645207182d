"""Filling fixed-capacity containers with items: best-fit decreasing per partition, certified by dual-feasible functions, with repacking of what is not full.

Items are spread over partitions of bounded size by a hash. Each is packed by best-fit decreasing, and a lower bound from dual-feasible functions
(Fekete & Schepers, 2001) says how many containers its items need at least. A partition that reaches its bound is certified; all but its emptiest container, which is the rounding of that bound, stay as they
are. Partitions with a gap exchange the items of their containers that are not nearly full, by another hash, and with them go the items of the emptiest containers of the certified
ones; what changed partitions is packed again. Rounds end when the bound of all items certifies the whole count, when a round saves nothing, or when they are used up.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.runtime import Scratch

EACH = 50_000  # items of a partition
SLACK = 0.01  # a container with more room than this share is not nearly full
ROUNDS = 4


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, items given in falling order: the fullest container with enough room (the oldest such), or a new one.

    Containers are kept by their room; which rooms occur is one integer's bits, so the least sufficient room is found without a search.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n, out = 0, 0, np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            container = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, container = capacity, n
            n += 1
        out[i] = container
        if left := room - size:
            by_room[left].append(container)
            rooms |= 1 << left
    return out


def lower_bound(size: np.ndarray, count: np.ndarray, capacity: int) -> int:
    """Containers that the items (distinct sizes with counts) need at least: the best of the functions f_e and u_k and of their plain sum.

    f_e takes sizes above capacity - e for a whole container and those below e for nothing; u_k takes size x for floor((k + 1) x / capacity) / k of a
    container, or for its exact share where that is whole. No container can hold more than 1 of either.
    """
    size, count = size.astype(np.int64), count.astype(np.int64)
    best = math.ceil(int((size * count).sum()) / capacity)
    for e in np.unique(np.minimum(size, capacity - size + 1))[:capacity].tolist():
        if 0 < 2 * e <= capacity + 1:
            value = np.where(size > capacity - e, capacity, np.where(size < e, 0, size))
            best = max(best, math.ceil(int((value * count).sum()) / capacity))
    for k in range(1, 21):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        value = np.where(whole, size * k, scaled // capacity * capacity)  # in units of 1 / (capacity * k)
        best = max(best, math.ceil(int((value * count).sum()) / (capacity * k)))
    return best


PACKED = "item string, piece int, size int, part int, bin int, filled int, emptiest boolean, gap int"


def packed(items: DataFrame, parts: int, seed: int, capacity: int) -> DataFrame:
    """Items (item, piece, size) with their containers (part, bin), how far those are filled, whether it is the emptiest of its partition, and by how many containers the partition exceeds its bound."""

    def run(table: pa.Table) -> pa.Table:
        size = table.column("size").to_numpy()
        order = np.lexsort((table.column("piece").to_numpy(), table.column("item").to_numpy(zero_copy_only=False), -size))
        table, size = table.take(pa.array(order)), size[order]
        bin_ = best_fit(size, capacity)
        bins = int(bin_.max()) + 1
        bound = lower_bound(*np.unique(size, return_counts=True), capacity)
        filled = np.bincount(bin_, size, bins).astype(np.int32)
        return pa.table([table.column("item"), table.column("piece"), table.column("size"), table.column("part"), pa.array(bin_, pa.int32()), pa.array(filled[bin_]), pa.array(bin_ == filled.argmin()), pa.array(np.full(len(size), bins - bound), pa.int32())], names=[x.split()[0] for x in PACKED.split(", ")])

    return items.select("item", "piece", "size", F.pmod(F.xxhash64("item", "piece", F.lit(seed)), F.lit(parts)).cast("int").alias("part")).groupBy("part").applyInArrow(run, PACKED)


def bound_of(items: DataFrame, capacity: int) -> tuple[int, int]:
    """The number of items and the bound of all of them, from the counts of their sizes (at most ``capacity`` different ones)."""
    sizes = items.groupBy("size").count().collect()
    return sum(r["count"] for r in sizes), lower_bound(np.array([r["size"] for r in sizes]), np.array([r["count"] for r in sizes]), capacity) if sizes else 0


def fill(items: DataFrame, capacity: int, each: int = EACH, rounds: int = ROUNDS) -> DataFrame:
    """``item``, ``piece``, ``size``, ``container_id`` of all items; sizes must be 1 to ``capacity``. No item is split or left out; equal items are packed each for itself.

    Memory: a task packs about ``each`` items. The driver sees counts and the distinct sizes (at most ``capacity``).
    """
    scratch = Scratch(items.sparkSession, "packing")
    todo = scratch.cut(items, "items")
    total, bound = bound_of(todo, capacity)
    if not total:
        return todo.select("item", "piece", "size", F.lit("").alias("container_id"))
    loose = F.col("emptiest") | (F.col("gap") > 0) & (F.col("filled") < capacity * (1 - SLACK))
    id_ = F.struct("part", "bin")
    measures = {"all": F.count_distinct(id_), "open": F.count_distinct(F.when(loose, id_)), "items": F.count_if(loose)}
    current = scratch.cut(packed(todo, math.ceil(total / each), 0, capacity).withColumn("round", F.lit(0)), "packed")
    scratch.drop("items")
    done: list[DataFrame] = []
    closed = 0
    for k in range(1, rounds + 1):
        n = current.agg(*[m.alias(name) for name, m in measures.items()]).collect()[0]
        if closed + n["all"] <= bound or n["open"] < 2:
            break
        again = scratch.cut(packed(current.where(loose), math.ceil(n["items"] / each), k, capacity).withColumn("round", F.lit(k)), f"again-{k}")
        if again.agg(F.count_distinct(id_)).collect()[0][0] >= n["open"]:
            break
        done.append(current.where(~loose))
        current, closed = again, closed + n["all"] - n["open"]
    for part in done:
        current = current.unionByName(part)
    return current.select("item", "piece", "size", F.concat_ws("-", "round", "part", "bin").alias("container_id"))


def certificate(filled: DataFrame, capacity: int) -> DataFrame:
    """One row on a result of ``fill``: items, their total size, containers, how full the fullest is, and the bound: the containers that any packing of these items needs at least."""
    total, bound = bound_of(filled, capacity)
    per = filled.groupBy("container_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.count(F.lit(1)).alias("containers"), F.max("size").alias("fullest"), F.lit(bound).cast("long").alias("bound"))


def pieces(counts: DataFrame, key: str, tokens: str, capacity: int) -> DataFrame:
    """Items of texts: one each, or, above the capacity, as many full pieces as it takes and the rest; texts of no tokens are no items."""
    n = F.col(tokens)
    whole = F.when(n <= capacity, F.array(n)).otherwise(F.concat(F.array_repeat(F.lit(capacity), F.floor(n / capacity).cast("int")), F.when(n % capacity > 0, F.array(n % capacity)).otherwise(F.array().cast("array<int>"))))
    return counts.where(n > 0).select(F.col(key).cast("string").alias("item"), F.posexplode(whole).alias("piece", "size"))
