"""Percentiles of very large numeric columns: merging centroid digests (Dunning, Ertl) per group and day, certified by counting.

Sorted values are clustered under a size function of their quantile: a cluster may span at most one unit of k(q) = d / (2 pi) * asin(2 q - 1), so clusters are
small near the ends. Digests are merged by clustering their centroids again. A group of up to ``EXACT`` values keeps them all, so its percentiles are exact.
For the others a second pass over the rows counts how many lie below each estimate, which gives the rank error itself rather than a bound; an estimate beyond the allowed error is replaced by the exact
percentile, from counts of the group's distinct values. Partial digests of groups that hold more than a handful of a task's rows are merged per day in two steps, first by group, day and a salt.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import order
from tracewell.runtime import Scratch

D = 500
EXACT = 256
QUANTILES = (0.5, 0.95, 0.99)
BUFFER = 1 << 18
#: Rank error that is allowed: half of the widest cluster, doubled for each of two further mergings. Estimates beyond it are replaced by exact percentiles.
BOUND = 4 * np.pi / D / 2
SALTS = 64  # tasks over which the partial digests of one group and day are spread at first


def clustered(group: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values or centroids of many groups at once, sorted by group and value, those of large groups clustered."""
    order = np.lexsort((value, group))
    group, value, weight = group[order], value[order], weight[order]
    if not len(group):
        return group, value, weight
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    if size.max() <= EXACT:
        return group, value, weight
    of = np.repeat(np.arange(len(start)), size)
    total = np.add.reduceat(weight, start)
    before = np.cumsum(weight) - weight
    q = (before - before[start][of] + weight / 2) / total[of]
    k = np.floor(D / (2 * np.pi) * np.arcsin(np.clip(2 * q - 1, -1, 1))).astype(np.int64)
    alone = size[of] <= EXACT
    # the least and the greatest value stay clusters of their own
    last = np.r_[start[1:], len(group)] - 1
    ends = np.zeros(len(group), bool)
    ends[start], ends[last] = True, True
    cut = np.r_[True, (of[1:] != of[:-1]) | (k[1:] != k[:-1]) | alone[1:] | ends[1:] | ends[:-1]]
    at = np.flatnonzero(cut)
    w = np.add.reduceat(weight, at)
    low, high = value[at], value[np.r_[at[1:], len(group)] - 1]
    mean = np.clip(np.add.reduceat(value * weight, at) / w, low, high)  # a cluster of equal values keeps their value to the last bit
    return group[at], mean, w


def quantile_of(mean: np.ndarray, weight: np.ndarray, q: Sequence[float]) -> np.ndarray:
    """Linear interpolation between the centres of the clusters; the usual percentile where all weights are 1."""
    centre = np.cumsum(weight) - weight + (weight - 1) / 2
    return np.interp(np.asarray(q) * (weight.sum() - 1), centre, mean)


def partials(df: DataFrame, day: str, kinds: dict[str, str | None], measures: Sequence[str]) -> DataFrame:
    """Partial digests of each map task's rows: ``kind``, ``key``, ``day`` and the centroids of all measures (``m``, ``mean``, ``weight``).

    ``kinds``: name of a grouping to its column, None for the day itself. Null, NaN and infinite values do not count; rows with a null or blank key
    belong to no group; rows without a day count under a null day (and not for the kind that is the day). Equal rows count each, ties are kept; very long keys are
    keys as any. Other columns are not read; an empty table gives no row.
    """
    keys = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) if c else F.coalesce(F.to_date(day).cast("string"), F.lit("")) for c in kinds.values()]
    rows = df.select(F.to_date(day).alias("day"), *[k.alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(measures)])
    n_kinds, names = len(kinds), list(kinds)

    def fold(buffer: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(buffer).combine_chunks()
        values = [np.asarray(pc.fill_null(table.column(1 + n_kinds + j), np.nan)) for j in range(len(measures))]
        finite = [np.isfinite(v) for v in values]
        day_code, days = coded(table.column(0))
        for i, name in enumerate(names):
            code, keys_ = coded(table.column(1 + i))
            named = np.asarray(pc.not_equal(keys_, ""))[code]
            group = code * len(days) + day_code
            used, group = np.unique(group, return_inverse=True)
            keep = [f & named for f in finite]
            g = np.concatenate([group[f] * len(measures) + j for j, f in enumerate(keep)])
            v = np.concatenate([x[f] for x, f in zip(values, keep)])
            g, v, w = clustered(g, v, np.ones(len(v)))
            yield from rows_of(g, v, w, len(measures), lambda at: [pa.array([name] * len(at), pa.string()), keys_.take(pa.array(used[at] // len(days))), days.take(pa.array(used[at] % len(days)))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, n = [], 0
        for batch in it:
            buffer.append(batch)
            n += batch.num_rows
            if n >= BUFFER:
                yield from fold(buffer)
                buffer, n = [], 0
        if n:
            yield from fold(buffer)

    return rows.mapInArrow(run, DIGEST)


DIGEST = "kind string, key string, day date, m array<int>, mean array<double>, weight array<double>"
NAMES = ["kind", "key", "day", "m", "mean", "weight"]


def coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    enc = pc.dictionary_encode(column, null_encoding="encode").combine_chunks()
    enc = enc.chunk(0) if isinstance(enc, pa.ChunkedArray) else enc
    return np.asarray(enc.indices).astype(np.int64), enc.dictionary


def rows_of(g: np.ndarray, v: np.ndarray, w: np.ndarray, measures: int, heads) -> Iterator[pa.RecordBatch]:
    """Sorted centroids (group * measures + measure) as one row a group, a few thousand rows a batch; weights of 1 are left out."""
    row = g // measures
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    for a in range(0, len(start), 4096):
        at = start[a : a + 4096]
        end = start[a + 4096] if a + 4096 < len(start) else len(row)
        offsets = pa.array(np.r_[at, end] - at[0], pa.int32())
        m, mean, weight = g[at[0] : end] % measures, v[at[0] : end], w[at[0] : end]
        ones = np.maximum.reduceat(weight, at - at[0]) == 1
        kept = ~np.repeat(ones, np.diff(np.r_[at, end]))
        w_offsets = np.r_[0, np.cumsum(np.add.reduceat(kept.astype(np.int64), at - at[0]))]
        yield pa.RecordBatch.from_arrays(
            [*heads(row[at]), pa.ListArray.from_arrays(offsets, pa.array(m, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(mean)), pa.ListArray.from_arrays(pa.array(w_offsets, pa.int32()), pa.array(weight[kept]))], NAMES
        )


def centroids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row number, measure, mean and weight of all centroids of a batch."""
    n = np.asarray(pc.list_value_length(batch.column(3)))
    row = np.repeat(np.arange(len(n)), n)
    m, mean = np.asarray(batch.column(3).flatten()).astype(np.int64), np.asarray(batch.column(4).flatten())
    weight = np.ones(len(m))
    given = np.asarray(pc.list_value_length(batch.column(5))) > 0
    weight[given[row]] = np.asarray(batch.column(5).flatten())
    return row, m, mean, weight


def folded(it: Iterator[pa.RecordBatch], measures: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Merges neighbouring rows that agree in the first ``parts`` of kind, key, day; the last group of a batch is carried on."""
    carry: pa.RecordBatch | None = None
    for batch in it:
        if not batch.num_rows:
            continue
        if carry is not None:
            batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
        *done, carry = merge_rows(batch, measures, parts)
        yield from done
    if carry is not None:
        yield carry


def merge_rows(batch: pa.RecordBatch, measures: int, parts: int) -> list[pa.RecordBatch]:
    """The merged groups of a batch, the last in a batch of its own."""
    row, m, mean, weight = centroids(batch)
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for c in range(parts):
        code, _ = coded(pa.chunked_array([batch.column(c)]))
        new[1:] |= code[1:] != code[:-1]
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    g, v, w = clustered(group[row] * measures + m, mean, weight)
    day = batch.column(2) if parts > 2 else pa.nulls(batch.num_rows, pa.date32())
    heads = lambda at: [batch.column(0).take(pa.array(first[at])), batch.column(1).take(pa.array(first[at])), day.take(pa.array(first[at]))]
    split = np.searchsorted(g, group[-1] * measures)
    return [*rows_of(g[:split], v[:split], w[:split], measures, heads), *rows_of(g[split:], v[split:], w[split:], measures, heads)]


def daily(df: DataFrame, day: str, kinds: dict[str, str | None], measures: Sequence[str]) -> DataFrame:
    """One digest per kind, key and day. Rows of a key stay together and in order of days, so ``combined`` needs no further shuffle.

    Of a group with many values, a task per salt merges the partial digests of a day, then a task per day those; only one digest a day comes to the task of the key.
    """
    n, by = len(measures), ["kind", "key", "day"]
    partial = Scratch(df.sparkSession, "digests").cut(partials(df, day, kinds, measures).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))), "partial")
    heavy = F.size("m") > EXACT
    merged = lambda rows: rows.sortWithinPartitions(*by).select(*NAMES).mapInArrow(lambda it: folded(it, n, 3), DIGEST)
    days = merged(merged(partial.where(heavy).repartition(*by, "salt")).repartition(*by))
    return merged(partial.where(~heavy).select(*NAMES).unionByName(days).repartition("kind", "key"))


def combined(days: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One digest per kind and key from the digests of single days."""
    n = len(measures)
    return days.mapInArrow(lambda it: folded(it, n, 2), DIGEST)


def regrouped(days: DataFrame, measures: Sequence[str]) -> DataFrame:
    """As ``combined``, for stored digests of days in any order."""
    return combined(days.repartition("kind", "key").sortWithinPartitions("kind", "key", "day"), measures)


def estimates(digests: DataFrame, measures: Sequence[str], quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """``kind``, ``key``, ``day``, ``measure``, ``n``, ``exact`` and ``q`` (array of percentiles) of each digest; a measure without values gives no row."""
    names, count = list(measures), len(measures)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            row, m, mean, weight = centroids(batch)
            if not len(row):
                continue
            g = row * count + m
            start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            size = np.diff(np.r_[start, len(g)])
            of = np.repeat(np.arange(len(start)), size)
            run_ = np.cumsum(weight)
            base = (run_ - weight)[start]
            total = np.add.reduceat(weight, start)
            centre = run_ - weight - base[of] + (weight - 1) / 2
            # all groups in one search: centres of a group lie above those of the groups before
            step = total.max() + 2
            line = centre + of * step
            out = np.empty((len(start), len(quantiles)))
            for j, q in enumerate(quantiles):
                want = q * (total - 1)
                hi = np.clip(np.searchsorted(line, want + np.arange(len(start)) * step, side="left"), start, start + size - 1)
                lo = np.maximum(hi - 1, start)
                span = centre[hi] - centre[lo]
                part = np.where(span > 0, np.clip((want - centre[lo]) / np.where(span > 0, span, 1), 0, 1), 1)
                out[:, j] = mean[lo] + part * (mean[hi] - mean[lo])
            exact = np.maximum.reduceat(weight, start) == 1
            head = pa.array(row[start])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(head) for c in range(3)], pa.array(names).take(pa.array(m[start])), pa.array(total.astype(np.int64)), pa.array(exact), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), len(quantiles)).cast(pa.list_(pa.float64()))],
                ["kind", "key", "day", "measure", "n", "exact", "q"],
            )

    return digests.mapInArrow(run, "kind string, key string, day date, measure string, n long, exact boolean, q array<double>")


def certified(df: DataFrame, found: DataFrame, day: str, kinds: dict[str, str | None], measures: Sequence[str], quantiles: Sequence[float] = QUANTILES, bound: float = BOUND) -> DataFrame:
    """``found`` (totals of ``estimates``) with ``rank_error`` of each percentile, counted over the rows; 0 for exact groups. None exceeds ``bound``.

    The estimates of inexact groups (each has over ``EXACT`` rows) are few; they are broadcast if a count proves so, else joined by a shuffle that splits hot keys.
    """
    scratch = Scratch(found.sparkSession, "digest")
    found = scratch.cut(found, "found")  # read twice below
    inexact = found.where(~F.col("exact")).groupBy("kind", "key").agg(F.map_from_entries(F.collect_list(F.struct("measure", "q"))).alias("qs"))
    inexact = scratch.small(inexact.select("kind", "key", *[F.element_at("qs", F.lit(m)).alias(f"q{i}") for i, m in enumerate(measures)]), "inexact", 20_000)
    keys = [F.struct(F.lit(k).alias("kind"), (F.trim(F.col(c).cast("string")) if c else F.to_date(day).cast("string")).alias("key")) for k, c in kinds.items()]
    finite = [F.when(F.abs(F.col(m).cast("double")) < float("inf"), F.col(m).cast("double")).alias(f"v{i}") for i, m in enumerate(measures)]
    rows = df.select(F.array(*keys).alias("keys"), *finite).select(F.inline("keys"), *[f"v{i}" for i in range(len(measures))])
    counts = []
    for i in range(len(measures)):
        for j in range(len(quantiles)):
            at = F.get(f"q{i}", F.lit(j))
            counts += [F.sum((F.col(f"v{i}") < at).cast("int")).alias(f"l{i}_{j}"), F.sum((F.col(f"v{i}") <= at).cast("int")).alias(f"h{i}_{j}")]
    counted = rows.join(inexact, ["kind", "key"]).groupBy("kind", "key").agg(*counts)
    pairs = [F.struct(F.lit(m).alias("measure"), F.array(*[F.struct(F.col(f"l{i}_{j}").alias("l"), F.col(f"h{i}_{j}").alias("h")) for j in range(len(quantiles))]).alias("c")) for i, m in enumerate(measures)]
    by_measure = scratch.small(counted.select("kind", "key", F.inline(F.array(*pairs))), "counted", 20_000 * len(measures))
    joined = found.join(by_measure, ["kind", "key", "measure"], "left")
    error = F.transform(F.col("c"), lambda x, j: F.greatest(F.lit(0.0), x["l"] / F.col("n") - F.element_at(F.array(*map(F.lit, quantiles)), j + 1), F.element_at(F.array(*map(F.lit, quantiles)), j + 1) - x["h"] / F.col("n")))
    done = joined.select("kind", "key", "measure", "n", "exact", "q", F.when(F.col("exact"), F.array(*[F.lit(0.0)] * len(quantiles))).otherwise(error).alias("rank_error"))
    far = F.array_max("rank_error") > bound
    done, seen = scratch.measured(done, "done", far=F.count_if(far))
    if not seen["far"]:
        return done
    wanted = scratch.small(done.where(far).select("kind", "key", "measure"), "far")
    values = rows.select("kind", "key", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"v{i}").alias("value")) for i, m in enumerate(measures)]))).where("value IS NOT NULL")
    counts = values.join(wanted, ["kind", "key", "measure"]).groupBy("kind", "key", "measure", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = order.cumulative(counts.select(F.struct("kind", "key", "measure").alias("g"), "value", "n"), "g", "value")
    exact = order.quantiles_of(placed, "g", quantiles).select("g.kind", "g.key", "g.measure", F.col("total").alias("n"), F.lit(True).alias("exact"), "q", F.array(*[F.lit(0.0)] * len(quantiles)).alias("rank_error"))
    return done.where(~far).unionByName(exact)
