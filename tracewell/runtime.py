"""What jobs need from the session: shared storage, size checks, partition counts."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; at 200 bytes a row this is 20 MB.
BROADCAST_ROWS = 100_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where that is unset (tests, one machine)."""
    sc = spark.sparkContext
    if not (base := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tracewell-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables that cut the lineage of an iteration: parquet in the shared folder, so that the loss of an executor loses none of them.

    ``cut`` writes and reads back; a slot's former table is deleted as soon as nothing can read it, that is one cut later.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.old, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}, 0

    def cut(self, df: DataFrame, slot: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{slot}-{self.n}"
        df.write.parquet(path)
        if slot in self.old:
            self.delete(self.old[slot])
        self.old[slot] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def measured(self, df: DataFrame, slot: str, **metrics: Column) -> tuple[DataFrame, dict]:
        """As ``cut``, with aggregates of what was written. (Not by ``observe``: a session that has observed once can no longer ship the models of Spark's forests.)"""
        done = self.cut(df, slot)
        return done, done.agg(*[m.alias(name) for name, m in metrics.items()]).collect()[0].asDict()

    def small(self, df: DataFrame, slot: str, most: int = BROADCAST_ROWS) -> DataFrame:
        """As ``cut``, with a broadcast hint if the written rows are counted to be at most ``most``: the plan runs once, not once to count and once to use."""
        done, seen = self.measured(df, slot, n=F.count(F.lit(1)))
        return F.broadcast(done) if seen["n"] <= most else done

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *slots: str) -> None:
        for slot in slots:
            if slot in self.old:
                self.delete(self.old.pop(slot))


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a bounded count proves it has at most ``most`` rows; as it is, for a shuffled join, otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hinted(df: DataFrame, n: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its known number of rows ``n`` allows it."""
    return F.broadcast(df) if n <= most else df


def partitions(spark: SparkSession, factor: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * factor)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def by_size(df: DataFrame, each: int = 64 << 20, least: int = 1) -> int:
    """A number of partitions of about ``each`` bytes by Catalyst's estimate."""
    return max(least, min(100_000, math.ceil(input_bytes(df) / each)))


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row table: a scalar subquery, so a literal in the plan and no join at all."""
    row = one.select(F.struct(*one.columns).alias("row")).scalar()
    return df.withColumn("_one", row).select(*df.columns, *[F.col("_one")[c].alias(c) for c in one.columns])
