"""Graphs as tables of edges: numbering of vertices, forests within tasks, minimum propagation by stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.runtime import Scratch, by_size

BLOCK = 1 << 19  # pairs that a task links at once


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of each vertex's component, for edges between the vertices 0 to n - 1: roots hook to smaller neighbouring roots, then all paths are shortened."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def forests(pairs: DataFrame) -> DataFrame:
    """``x`` and ``root``: the values of each block of a task's pairs (``a``, ``b`` strings, null for none), once a block, with the smallest value (by bytes) that the block's pairs link them to.

    The pairs link what the forests link, but a forest has no more edges than values: repeated pairs, and paths within a block, are gone before anything is shuffled.
    """

    def block(buffer: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(buffer)
        every = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks], pa.string())
        enc = every.combine_chunks().dictionary_encode()
        enc = enc.chunk(0) if isinstance(enc, pa.ChunkedArray) else enc
        order = pc.sort_indices(enc.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[np.asarray(order)] = np.arange(len(order))
        code = np.asarray(pc.fill_null(enc.indices, -1)).astype(np.int64)
        a, b = code[: len(table)], code[len(table) :]
        both = (a >= 0) & (b >= 0)
        names = enc.dictionary.take(order)
        return pa.RecordBatch.from_arrays([names, names.take(pa.array(roots(rank[a[both]], rank[b[both]], len(order))))], ["x", "root"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, n = [], 0
        for batch in it:
            buffer.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield block(buffer)
                buffer, n = [], 0
        if n:
            yield block(buffer)

    return pairs.select("a", "b").mapInArrow(run, "x string, root string")


def numbered(values: DataFrame, x: str) -> DataFrame:
    """The distinct values ``x``, each with a long ``id``; ids are in the order of the values. One shuffle: ranges of values, in which equal ones meet."""
    ranged = values.select(x).repartitionByRange(by_size(values, 64 << 20, least=1), x)
    return ranged.groupBy(x).agg(F.lit(1).alias("_one")).sortWithinPartitions(x).select(x, F.monotonically_increasing_id().alias("id"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def star_round(edges: DataFrame, scratch: Scratch, slot: str) -> tuple[DataFrame, tuple]:
    """One large-star and one small-star step (Kiveris et al., 2014) on edges (u above v): the same components with paths about halved. Also a fingerprint of the new edges."""
    ways = both_ways(edges)
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    edges = scratch.cut(large.distinct(), slot)
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    small = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    edges, mark = scratch.measured(small.distinct(), slot, n=F.count(F.lit(1)), x=F.bit_xor(F.xxhash64("u", "v")))
    return edges, (mark["n"], mark["x"])


def stars(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (u above v) to stars: each vertex once as ``u`` with the smallest vertex of its component as ``v``; that vertex itself isn't listed.

    Rounds grow with the logarithm of the longest path. A hub's edges are joined with its one row, a join that adaptive execution splits.
    """
    edges, first = scratch.measured(edges, "stars", n=F.count(F.lit(1)), x=F.bit_xor(F.xxhash64("u", "v")))
    mark = (first["n"], first["x"])
    while mark[0]:
        edges, now = star_round(edges, scratch, "stars")
        if now == mark:
            break
        mark = now
    return edges
