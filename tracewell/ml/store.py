"""Fitted models on disk, with a checksum and the features they were fitted on."""

from __future__ import annotations

import hashlib
import io
import json

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def save_forest(spark: SparkSession, path: str, forest: list[np.ndarray], features: list[str]) -> str:
    """Writes an isolation forest; returns the SHA-256 of its content."""
    out = io.BytesIO()
    np.savez(out, *forest)
    digest = hashlib.sha256(out.getvalue()).hexdigest()
    row = [(bytearray(out.getvalue()), json.dumps(features), digest)]
    spark.createDataFrame(row, "content binary, features string, sha256 string").coalesce(1).write.mode("overwrite").parquet(path)
    return digest


def load_forest(spark: SparkSession, path: str, features: list[str]) -> list[np.ndarray] | None:
    """The stored forest; None, so that the caller fits anew, unless it was fitted on exactly these features. A changed content is an error."""
    row = spark.read.parquet(path).withColumn("now", F.sha2("content", 256)).collect()[0]
    if row["now"] != row["sha256"]:
        raise ValueError(f"{path}: the content does not match its checksum")
    if json.loads(row["features"]) != list(features):
        return None
    with np.load(io.BytesIO(bytes(row["content"]))) as z:
        return [z[k] for k in z.files]
