"""Writers: enriched tables, samples, split exports, lists, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """Arrays of plain values as pipe texts, other nested columns as JSON: what a CSV can hold."""
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind.startswith("array<") and not any(x in kind for x in ("struct", "map", "array<array")):
            out.append(F.array_join(F.col(f.name).cast("array<string>"), "|").alias(f.name))
        elif kind.startswith(("array", "struct", "map")):
            out.append(F.to_json(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, **options) -> None:
    flat(df).write.mode("overwrite").options(header=True, escape='"', **options).csv(path)


def write_json(df: DataFrame, path: str, rows: int | None = None) -> None:
    (df if rows is None else df.limit(rows)).write.mode("overwrite").json(path)


def write_xml(df: DataFrame, path: str, rows: int | None = None) -> None:
    flat(df if rows is None else df.limit(rows)).write.mode("overwrite").format("xml").option("rowTag", "transaction").option("rootTag", "transactions").save(path)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines in one file: for reports of few rows."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def split_layers(df: DataFrame, share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A ledger and a telemetry table from joint rows; a keyed ``share`` of transactions gets one to three further observations."""
    h = F.pmod(F.xxhash64("txid", F.lit(seed)), F.lit(1_000_000))
    extra = F.when(h < share * 1_000_000, 1 + h % 3).otherwise(0).cast("int")
    wire = df.select("txid", "ts", "src_ip", "dst_ip", "src_port", "dst_port", F.explode(F.sequence(F.lit(0), extra)).alias("k"))
    wire = wire.select((F.col("ts").cast("timestamp") + F.make_dt_interval(secs=(F.col("k") * 12.5).cast("decimal(18,6)"))).cast("timestamp_ntz").alias("ts"), "src_ip", "dst_ip", "src_port", "dst_port", "txid")
    return df.drop("src_ip", "dst_ip", "src_port", "dst_port", "geo_country"), wire


def watchlist_rows(df: DataFrame, most: int = 50) -> DataFrame:
    """A watchlist from flagged rows: the first inputs of the highest scores, severity by score. ``most`` entries, as the list is for people."""
    top = df.where("is_anomaly").orderBy(F.desc("risk_score"), "txid").limit(most)
    return top.select(F.get("ins", F.lit(0)).alias("indicator"), F.lit("address").alias("type"), F.col("detected_type").alias("label"), F.least(F.lit(1.0), F.col("risk_score") / 100).alias("severity")).dropDuplicates(["indicator"])
