"""A calibrated forest: balanced random forests (Breiman, 2001) on stratified parts, isotonic calibration on what each left out, averaged.

Forests learn from a bounded keyed sample of the labelled rows (``LEARNT``); tasks grow the trees, level by level, from the sample's binned features; all rows are scored in Arrow batches.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.ml.iforest import value
from tracewell.operators.features import fold_of, leak_free
from tracewell.runtime import Scratch, partitions

LEARNT = 20_000  # labelled rows that models are fitted on, at most; every row is scored
BINS = 128  # bins of a feature in which splits are sought; features with fewer distinct values are split exactly
CHUNK = 10  # trees that a task grows at once


def assembled(df: DataFrame, key: str, features: Sequence[str], label: str, folds: int, parts: int) -> DataFrame:
    """``key`` (a unique long), ``label``, the features, a stratified ``fold``, and within each fold a stratified ``part``; rows without a label are left out."""
    leak_free(features)
    rows = df.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"), *[value(f).alias(f"x{i}") for i, f in enumerate(features)]).where("label IS NOT NULL")
    dealt = fold_of(rows, "label", "key", folds).withColumnRenamed("fold", "outer")
    return fold_of(dealt.withColumn("group", F.concat_ws(" ", F.col("label").cast("string"), F.col("outer").cast("string"))), "group", "key", parts).withColumnsRenamed({"fold": "part", "outer": "fold"}).drop("group")


def sampled(rows: DataFrame, most: int = LEARNT, seed: int = 42) -> tuple[np.ndarray, ...]:
    """Features, labels, folds and parts of the rows with the least keyed hashes, at most ``most``: the same rows on any partitioning."""
    pdf = rows.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(most).toPandas()
    names = [c for c in pdf.columns if c.startswith("x")]
    return pdf[names].to_numpy(float), pdf["label"].to_numpy(float), pdf["fold"].to_numpy(int), pdf["part"].to_numpy(int)


def edges_of(x: np.ndarray) -> list[np.ndarray]:
    """Per feature the values between which splits are sought."""
    out = []
    for column in x.T:
        known = np.unique(column)
        out.append((known[:-1] + known[1:]) / 2 if len(known) <= BINS else np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])))
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Features to bins: bin b holds values above the edge b - 1 and at most the edge b."""
    return np.column_stack([np.searchsorted(e, c, "left") for c, e in zip(x.T, edges)]).astype(np.uint8) if len(x) else np.zeros((0, len(edges)), np.uint8)


TREE = np.dtype([("feature", "i2"), ("bin", "u1"), ("left", "i4"), ("p", "f4")])  # feature -1: a leaf; the right child follows the left one


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator, depth: int, tried: int) -> np.ndarray:
    """A tree of least weighted impurity, all nodes of a level at once. Each node tries ``tried`` features at random, and the others where none of these divides it."""
    n_features = bins.shape[1]
    out = [np.zeros(1, TREE)]
    rows = np.flatnonzero(w > 0)
    node, base, count = np.zeros(len(rows), np.int64), 0, 1  # place in the level, number of its first node, nodes in it
    for level in range(depth + 1):
        total, ones = np.bincount(node, w[rows], count), np.bincount(node, w[rows] * y[rows], count)
        here = out[-1]
        here["p"], here["feature"] = ones / np.maximum(total, 1e-300), -1
        open_ = (ones > 1e-12) & (total - ones > 1e-12 * total) & (level < depth)
        best, at_f, at_b = np.full(count, 1e-9), np.full(count, -1), np.zeros(count, np.int64)
        rank = rng.random((count, n_features)).argsort(1).argsort(1)
        for again in (False, True):
            todo = open_ & (at_f < 0) if again else open_
            if not todo.any():
                break
            for f in range(n_features):
                wanted = todo & ((rank[:, f] >= tried) if again else (rank[:, f] < tried))
                if not wanted.any():
                    continue
                place = np.cumsum(wanted) - 1
                mine = wanted[node]
                r, k = rows[mine], place[node[mine]]
                size = int(wanted.sum())
                cell = k * (BINS + 1) + bins[r, f]
                a = np.bincount(cell, w[r], size * (BINS + 1)).reshape(size, BINS + 1).cumsum(1)
                b = np.bincount(cell, w[r] * y[r], size * (BINS + 1)).reshape(size, BINS + 1).cumsum(1)
                t, o = a[:, -1:], b[:, -1:]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = b * b / a + (o - b) ** 2 / (t - a) + (a - b) ** 2 / a + ((t - a) - (o - b)) ** 2 / (t - a) - (o * o + (t - o) ** 2) / t
                gain[(a < 1e-9) | (t - a < 1e-9)] = -1
                cut = gain.argmax(1)
                won = gain[np.arange(size), cut]
                who = np.flatnonzero(wanted)
                better = won > best[who]
                best[who[better]], at_f[who[better]], at_b[who[better]] = won[better], f, cut[better]
        divided = at_f >= 0
        if not divided.any():
            break
        child = np.cumsum(divided) - 1
        here["feature"][divided], here["bin"][divided], here["left"][divided] = at_f[divided], at_b[divided], base + count + 2 * child[divided]
        keep = divided[node]
        rows, node = rows[keep], node[keep]
        node = 2 * child[node] + (bins[rows, at_f[node]] > at_b[node])
        base, count = base + count, 2 * int(divided.sum())
        out.append(np.zeros(count, TREE))
    return np.concatenate(out)


def forests(spark: SparkSession, bins: np.ndarray, y: np.ndarray, groups: list[np.ndarray], trees: int, depth: int, seed: int = 42) -> list[list[np.ndarray]]:
    """A forest of ``trees`` trees for each group of rows: tasks grow a few trees each from bootstrap samples, with weights that balance the classes."""
    shared = spark.sparkContext.broadcast((bins, y, groups))
    tried = max(1, int(np.sqrt(bins.shape[1])))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, y, groups = shared.value
        for batch in it:
            for chunk in batch.column(0).to_pylist():
                g, first = divmod(chunk * CHUNK, padded)
                rows, found = groups[g], []
                for t in range(first, min(first + CHUNK, trees)):
                    rng = np.random.default_rng((seed, g, t))
                    positive = max(y[rows].mean(), 1e-9) if len(rows) else 0.5
                    drawn = np.bincount(rng.integers(0, len(rows), len(rows)), minlength=len(rows)) * np.where(y[rows] == 1, 0.5 / positive, 0.5 / max(1 - positive, 1e-9)) if len(rows) else np.zeros(0)
                    w = np.zeros(len(y))
                    w[rows] = drawn
                    found.append((g, grow(bins, y, w, rng, depth, tried).tobytes()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(found), pa.int64()), pa.array([g for g, _ in found], pa.int32()), pa.array([t for _, t in found], pa.binary())], ["chunk", "g", "tree"])

    padded = -(-trees // CHUNK) * CHUNK
    chunks = spark.range(0, padded // CHUNK * len(groups), 1, min(partitions(spark, 4), max(1, padded // CHUNK * len(groups))))
    out: list[list[np.ndarray]] = [[] for _ in groups]
    for r in chunks.mapInArrow(run, "chunk long, g int, tree binary").toArrow().sort_by("chunk").to_pylist():
        out[r["g"]].append(np.frombuffer(r["tree"], TREE))
    shared.destroy()
    return out


def probability(forest: list[np.ndarray], bins: np.ndarray) -> np.ndarray:
    """Mean over the trees of the share of positives in a row's leaf."""
    out, every = np.zeros(len(bins)), np.arange(len(bins))
    for tree in forest:
        at = np.zeros(len(bins), np.int64)
        live = every[tree["feature"][at] >= 0]
        while len(live):
            nodes = tree[at[live]]
            at[live] = nodes["left"] + (bins[live, nodes["feature"]] > nodes["bin"])
            live = live[tree["feature"][at[live]] >= 0]
        out += tree["p"][at]
    return out / max(len(forest), 1)


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the rising steps nearest to ``y`` by pooling neighbours that fall; between places the value is interpolated."""
    if not len(p):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    place, back = np.unique(p, return_inverse=True)
    weight, total = np.bincount(back).astype(float), np.bincount(back, y)
    blocks: list[list[float]] = []  # sum, weight, places
    for t, w in zip(total.tolist(), weight.tolist()):
        blocks.append([t, w, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t2, w2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + w2, blocks[-1][2] + n2]
    return place, np.repeat([t / w for t, w, _ in blocks], [int(n) for *_, n in blocks])


class Calibrated:
    """Forests with their isotonic steps: everything that scoring needs."""

    def __init__(self, edges: list[np.ndarray], members: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]]):
        self.edges, self.members = edges, members

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean probability before and after calibration."""
        bins = binned(x, self.edges)
        raw = [probability(f, bins) for f, *_ in self.members]
        return np.mean(raw, 0), np.mean([np.interp(r, place, level) for r, (_, place, level) in zip(raw, self.members)], 0)


def fit(spark: SparkSession, x: np.ndarray, y: np.ndarray, part: np.ndarray, parts: int, trees: int, depth: int) -> Calibrated:
    """``parts`` forests, each learnt from the other parts and calibrated on the one it left out."""
    edges = edges_of(x)
    bins = binned(x, edges)
    grown = forests(spark, bins, y, [np.flatnonzero(part != c) for c in range(parts)], trees, depth)
    return Calibrated(edges, [(f, *isotonic(probability(f, bins[part == c]), y[part == c])) for c, f in enumerate(grown)])


def predicted(model: Calibrated, rows: DataFrame, features: int) -> DataFrame:
    """``key``, ``label``, ``raw`` and ``p`` of rows as of ``assembled``. The model is broadcast: about 10 bytes a node."""
    shared = rows.sparkSession.sparkContext.broadcast(packed(model))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unpacked(shared.value)
        for batch in it:
            raw, p = model.predict(np.column_stack([np.asarray(batch.column(2 + i)) for i in range(features)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw), pa.array(p)], ["key", "label", "raw", "p"])

    kind = rows.schema["key"].dataType.simpleString()
    spread = rows.select("key", "label", *[f"x{i}" for i in range(features)]).repartition(partitions(rows.sparkSession))  # scoring is the work here, whatever the files' sizes
    return spread.mapInArrow(run, f"key {kind}, label double, raw double, p double")


def out_of_fold(df: DataFrame, key: str, features: Sequence[str], label: str, folds: int = 5, parts: int = 3, trees: int = 300, depth: int = 64, most: int = LEARNT) -> DataFrame:
    """``key``, ``label``, ``ml_probability`` (0-100) of every labelled row by models that did not see its fold: the mean of ``parts`` forests, each calibrated by isotonic regression on the part it left out."""
    scratch = Scratch(df.sparkSession, "supervised")
    rows = scratch.cut(assembled(df, key, features, label, folds, parts), "rows")
    x, y, fold, part = sampled(rows, most)
    out: DataFrame | None = None
    for k in range(folds):
        use = fold != k
        model = fit(df.sparkSession, x[use], y[use], part[use], parts, trees, depth)
        scored = scratch.cut(predicted(model, rows.where(F.col("fold") == k), len(features)), f"scored-{k}")
        out = scored if out is None else out.unionByName(scored)
    return out.select(F.col("key").alias(key), "label", (F.col("p") * 100).alias("ml_probability"))


def packed(model: Calibrated) -> bytes:
    """A model as bytes, without pickled code."""
    content = io.BytesIO()
    arrays = {f"edges-{i}": e for i, e in enumerate(model.edges)}
    for m, (forest, place, level) in enumerate(model.members):
        arrays |= {f"tree-{m}-{t}": tree for t, tree in enumerate(forest)} | {f"place-{m}": place, f"level-{m}": level}
    np.savez(content, **arrays)
    return content.getvalue()


def unpacked(content: bytes) -> Calibrated:
    with np.load(io.BytesIO(content)) as z:
        count = lambda head: sum(n.startswith(head) for n in z.files)
        members = [([z[f"tree-{m}-{t}"] for t in range(count(f"tree-{m}-"))], z[f"place-{m}"], z[f"level-{m}"]) for m in range(count("place-"))]
        return Calibrated([z[f"edges-{i}"] for i in range(count("edges-"))], members)
