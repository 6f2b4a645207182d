"""Isolation forest (Liu, Ting & Zhou, 2008): trees of a bounded keyed sample, scoring of all rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES, SAMPLE, SEED = 200, 256, 42
POOL = TREES * SAMPLE  # rows from which the trees draw, at most


def normal_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> np.ndarray:
    """A tree as rows (feature, threshold, left, right, path length at a leaf); feature -1 is a leaf."""
    nodes: list[list[float]] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        low, high = x[rows].min(0), x[rows].max(0)
        open_ = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_):
            nodes.append([-1, 0, 0, 0, depth + normal_path(len(rows))])
            continue
        f = int(rng.choice(open_))
        at = rng.uniform(low[f], high[f])
        left = x[rows, f] < at
        todo += [(rows[left], depth + 1, len(nodes), 0), (rows[~left], depth + 1, len(nodes), 1)]
        nodes.append([f, at, 0, 0, 0])
    return np.array(nodes)


def fit(df: DataFrame, key: str, features: Sequence[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> list[np.ndarray]:
    """The forest. The pool is the rows with the least keyed hashes, at most trees x sample, so the same rows on any partitioning."""
    pool = df.select(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), *[value(f).alias(f) for f in features]).orderBy("h").limit(trees * sample).toPandas()
    x, rng = pool[list(features)].to_numpy(float), np.random.default_rng(seed)
    n = min(sample, len(x))
    limit = int(np.ceil(np.log2(max(n, 2))))
    return [grow(x[rng.choice(len(x), n, replace=False)], rng, limit) for _ in range(trees)] if n else []


def value(f: str):
    v = F.col(f).cast("double")
    return F.coalesce(F.when(F.abs(v) < float("inf"), v), F.lit(0.0))


def score(df: DataFrame, key: str, features: Sequence[str], forest: list[np.ndarray], sample: int = SAMPLE) -> DataFrame:
    """``key`` and ``anomaly_score`` in (0, 1); missing and infinite values count as 0. The forest (under 5 MB) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(forest)
    rows = df.select(F.col(key).alias("k"), *[value(f).alias(f) for f in features])
    norm = normal_path(sample)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.column_stack([np.asarray(batch.column(i + 1)) for i in range(len(features))])
            path = np.zeros(len(x))
            rows_ = np.arange(len(x))
            for tree in shared.value:
                at = np.zeros(len(x), np.int64)
                while True:
                    f = tree[at, 0].astype(np.int64)
                    live = f >= 0
                    if not live.any():
                        break
                    goes = x[rows_[live], f[live]] >= tree[at[live], 1]
                    at[live] = tree[at[live], 2 + goes.astype(np.int64)].astype(np.int64)
                path += tree[at, 4]
            out = 2.0 ** (-path / max(len(shared.value), 1) / norm)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["k", "anomaly_score"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, anomaly_score double").withColumnRenamed("k", key)
