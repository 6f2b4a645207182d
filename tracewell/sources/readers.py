"""Ledger files as DataFrames of strings: CSV, JSON and XML, guarded by size, behind one registry."""

from __future__ import annotations

import mimetypes
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import columns as X
from tracewell.operators import records

MAX_FILE_MB = 200
MAX_ROWS = 2_000_000
LISTS = ("input_addresses", "output_addresses", "input_amounts", "output_amounts")
SCALARS = ("timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "txid", "fee", "script_type", "geo_country")
FIELDS = (*SCALARS, *LISTS)


def file_bytes(spark: SparkSession, path: str) -> int | None:
    """Bytes under a path on any file system; None if it does not exist."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(at).getLength() if fs.exists(at) else None


def guard_size(spark: SparkSession, path: str, max_mb: float | None = None) -> None:
    """Refuses files over the limit (parameter, else the variable TRACEWELL_MAX_FILE_SIZE_MB, else 200 MB); a missing path is left to the reader. A limit of 0 is none."""
    limit = max_mb if max_mb is not None else float(os.environ.get("TRACEWELL_MAX_FILE_SIZE_MB", MAX_FILE_MB))
    size = file_bytes(spark, path)
    if limit and size is not None and size > limit * (1 << 20):
        raise ValueError(f"{path} has {size / (1 << 20):.1f} MB; the limit is {limit:g} MB")


def guard_rows(df: DataFrame, most: int | None = MAX_ROWS) -> DataFrame:
    """Refuses tables over the limit; counts no further than one row past it. No limit: None."""
    if most is not None and df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


class Adapter:
    """One file format. Subclasses give ``load``; ``load_data`` also takes a DataFrame."""

    def __init__(self, spark: SparkSession, max_mb: float | None = None, max_rows: int | None = MAX_ROWS):
        self.spark, self.max_mb, self.max_rows = spark, max_mb, max_rows

    def read(self, path: str) -> DataFrame:
        raise NotImplementedError

    def load(self, path: str) -> DataFrame:
        """All fields as strings, lists as pipe texts, with ``row_idx`` in the order of the file."""
        guard_size(self.spark, path, self.max_mb)
        return with_order(guard_rows(self.read(path), self.max_rows))

    def load_data(self, source: str | DataFrame) -> DataFrame:
        if isinstance(source, str):
            return self.load(source)
        return source if "row_idx" in source.columns else with_order(source)


def with_order(df: DataFrame) -> DataFrame:
    """A load order: increasing within and over the partitions as they were read."""
    return df.withColumn("row_idx", F.monotonically_increasing_id())


class CsvAdapter(Adapter):
    """With a heading; tabs part the fields of files that end in ``.tsv``. Quoted fields may hold line breaks, so a file is one task's work; ``load_lines`` splits files without a heading."""

    def read(self, path: str) -> DataFrame:
        tab = "\t" if path.lower().endswith(".tsv") else ","
        return self.spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').option("sep", tab).csv(path)

    def load_lines(self, path: str) -> tuple[DataFrame, DataFrame]:
        """Ledger files without a heading, in byte ranges: the records that load, as strings with ``row_idx``, and those that fail, with file, place and reason."""
        parsed = with_order(records.read_files(self.spark, path))
        fields = [F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(records.COLUMNS)]
        return parsed.where("reason IS NULL").select("row_idx", *fields), parsed.where("reason IS NOT NULL").select("file_name", "at_byte", "record_no", "at", "reason")


class JsonAdapter(Adapter):
    """An array of objects, one object, or objects keyed by txid; lines of objects for names that end in ``.jsonl``."""

    def read(self, path: str) -> DataFrame:
        if path.endswith((".jsonl", ".ndjson")):
            records = self.spark.read.text(path).select(F.lit(None).cast("string").alias("key"), F.try_parse_json("value").alias("v"))
            return self.fields(records)
        text = self.spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
        shapes = [r[0] for r in text.select(F.coalesce(F.schema_of_variant("doc"), F.lit("INVALID"))).distinct().collect()]  # one per file
        if bad := [s for s in shapes if not s.startswith(("ARRAY", "OBJECT"))]:
            raise ValueError(f"{path}: no JSON array or object ({bad[0]})")
        each = self.spark.sql("SELECT schema_of_variant(doc) AS shape, doc, e.key AS key, e.value AS v FROM {text}, LATERAL variant_explode(doc) AS e", text=text)
        nested = F.schema_of_variant("v").startswith("OBJECT")
        single = F.col("shape").startswith("OBJECT") & F.expr("variant_get(doc, '$.txid', 'string')").isNotNull()
        if each.where(~nested & ~single).limit(1).count():
            raise ValueError(f"{path}: records must be objects")
        one = text.where(F.expr("variant_get(doc, '$.txid', 'string')").isNotNull() & F.schema_of_variant("doc").startswith("OBJECT")).select(F.lit(None).cast("string").alias("key"), F.col("doc").alias("v"))
        return self.fields(each.where(~single).select("key", "v").unionByName(one))

    def fields(self, records: DataFrame) -> DataFrame:
        def field(name: str) -> Column:
            at = f"variant_get(v, '$.{name}', 'variant')"
            text = F.expr(f"CASE WHEN schema_of_variant({at}) LIKE 'ARRAY%' THEN array_join(variant_get(v, '$.{name}', 'array<string>'), '|') ELSE try_variant_get(v, '$.{name}', 'string') END")
            return F.coalesce(text, F.col("key")) if name == "txid" else text

        return records.select(*[field(n).alias(n) for n in FIELDS])


class XmlAdapter(Adapter):
    """``transaction`` elements at any depth; lists as pipe text or as children. Documents with a DOCTYPE or entities are refused before parsing."""

    def read(self, path: str) -> DataFrame:
        if self.spark.read.text(path).where(F.upper("value").rlike("<!(DOCTYPE|ENTITY)")).limit(1).count():
            raise ValueError(f"{path}: document type definitions are not accepted")
        kind = lambda child: T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField(child, T.ArrayType(T.StringType()))])
        schema = T.StructType([T.StructField(n, kind("address" if "addresses" in n else "amount") if n in LISTS else T.StringType()) for n in FIELDS])
        rows = self.spark.read.format("xml").option("rowTag", "transaction").option("mode", "FAILFAST").schema(schema).load(path)
        flat = rows.select(*[F.coalesce(F.array_join(f"{n}.{'address' if 'addresses' in n else 'amount'}", "|"), F.trim(F.col(f"{n}._VALUE"))).alias(n) if n in LISTS else F.trim(F.col(n)).alias(n) for n in FIELDS])
        if not flat.limit(1).count():
            raise ValueError(f"{path}: no transactions")
        return flat


ADAPTERS = {"csv": CsvAdapter, "json": JsonAdapter, "xml": XmlAdapter}
EXTENSIONS = {".csv": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".xml": "xml"}
CHAINS = {"bitcoin": "csv", "btc": "csv"}


def get_adapter(spark: SparkSession, path: str | None = None, *, chain: str | None = None, **options) -> Adapter:
    """By chain, else by extension, else by MIME type, else CSV; an unknown chain or another known file type is an error."""
    if chain is not None and path is None:
        if chain.lower() not in CHAINS:
            raise ValueError(f"unknown chain: {chain}")
        return ADAPTERS[CHAINS[chain.lower()]](spark, **options)
    ext = os.path.splitext(path or "")[1].lower()
    if ext in EXTENSIONS:
        return ADAPTERS[EXTENSIONS[ext]](spark, **options)
    mime = mimetypes.guess_type(path or "")[0]
    for part, name in (("json", "json"), ("xml", "xml"), ("csv", "csv")):
        if mime and part in mime:
            return ADAPTERS[name](spark, **options)
    if ext:
        raise ValueError(f"unsupported file type: {ext}")
    return CsvAdapter(spark, **options)


def read_pair(spark: SparkSession, ledger: str, wire: str) -> tuple[DataFrame, DataFrame]:
    """Ledger and telemetry from two files."""
    telemetry = CsvAdapter(spark).read(wire)
    return get_adapter(spark, ledger).load(ledger), telemetry


def iso_codes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``iso2``, ``id`` (the numeric code, without leading zeros), ``country_name`` of all countries: from a file with these columns, else the platform's own list, which has no numeric codes."""
    if path is not None:
        return spark.read.option("header", True).csv(path).select("iso2", "id", "country_name")
    locale = spark.sparkContext._jvm.java.util.Locale
    names = [(code, None, locale("", code).getDisplayCountry(locale.ENGLISH)) for code in locale.getISOCountries()]
    return spark.createDataFrame(names, "iso2 string, id string, country_name string")


def range_database(spark: SparkSession, names: Sequence[str], folders: Sequence[str]) -> tuple[DataFrame | None, dict[str, str | None]]:
    """The first of the files ``names`` in the folders, in order, as ranges (``lo``, ``hi`` longs, ``country``, ``asn``, ``org``; CSV with heading ``first_ip, last_ip, ...``), and its status."""
    at = next((f"{d}/{n}" for n in names for d in folders if file_bytes(spark, f"{d}/{n}") is not None), None)
    status = {"path": at, "name": at and os.path.basename(at), "in_use": (at and os.path.basename(at)) or "none"}
    if at is None:
        return None, status
    rows = spark.read.option("header", True).csv(at)
    return rows.select(X.ip_number("first_ip").alias("lo"), X.ip_number("last_ip").alias("hi"), "country", "asn", "org").where("lo <= hi"), status


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """A whitelist file; a missing one is an empty list."""
    if file_bytes(spark, path) is None:
        return spark.createDataFrame([], "address string, entity_name string, risk_override double")
    return spark.read.option("header", True).csv(path)


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    """A watchlist file: known types only, severity 0.5 unless given; a missing file is an empty list."""
    if file_bytes(spark, path) is None:
        return spark.createDataFrame([], "indicator string, type string, label string, severity double")
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.trim("indicator").alias("indicator"), F.lower(F.trim("type")).alias("type"), "label", F.coalesce(F.col("severity").try_cast("double"), F.lit(0.5)).alias("severity")).where("type IN ('address', 'ip', 'asn') AND indicator <> ''")
