"""Rows that fail to parse: an error-recovering recursive-descent grammar for delimited records.

    text   := (anchor record (newline record)*)*
    record := field ("," field)*
    field  := quoted | bare
    quoted := '"' (any but '"' | '""')* '"'      right before "," or the end of the record
    bare   := (any but '"' and ",")*

Anchors are validated record starts; no record reaches past the next one. A broken quote is reported with the place of its field, and the parser resumes at the next anchor, so one lost
quote costs one record however many quotes follow. In delivered lines (``parse_lines``) each line's first character is an anchor by definition, and newlines inside are
part of its fields. In whole files (``read_files``) an anchor is a line start that itself parses as the beginning of a record: a time and two addresses on the wire (any of the
three may be blank or odd, but not all). What follows a broken quote up to the next anchor belongs to the broken record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a ledger file, in order.
COLUMNS = ("timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "txid", "input_addresses", "output_addresses", "input_amounts", "output_amounts", "fee", "script_type", "geo_country")
AMOUNTS, FEE, PORT = COLUMNS.index("input_amounts"), COLUMNS.index("fee"), COLUMNS.index("src_port")

QUOTED = re.compile(r'"((?:[^"]|"")*)"')
BARE = re.compile(r'[^",]*')
NUMBER = re.compile(r"([+-]?)((?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))(?:[eE][+-]?[0-9]+)?")
PORT_NUMBER = re.compile(r"([0-9]+)(?:\.0+)?")
WORDS = frozenset({"", "nan", "none", "null"})
#: The beginning of a record: a time and two fields that may be addresses, or any first field and two addresses.
BEGINNING = r'(?:[ \t]*"?[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9:.]{5,15}[^",\r\n]{0,12}"?,[ \t]*"?[0-9A-Za-z:. ]{0,45}"?,[ \t]*"?[0-9A-Za-z:. ]{0,45}"?,|[^",\r\n]{0,40},[ \t]*"?(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})[ \t]*"?,[ \t]*"?(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})[ \t]*"?,)'
ANCHOR = re.compile(rf"(?<=[\r\n])(?![\r\n])(?={BEGINNING})")
ANCHOR_BYTES = re.compile(ANCHOR.pattern.encode())
NEWLINE = re.compile(r"\r?\n|\r")
SPLIT = 32 << 20  # bytes of a file that a task reads
AHEAD = 1 << 20  # bytes read at once beyond them, up to the next anchor
BLANKS = " \t"


@dataclass
class Record:
    fields: list[str] = field(default_factory=list)
    reason: str | None = None
    at: int | None = None  # character at which the error lies
    start: int = 0
    end: int = 0


def amount(text: str) -> bool:
    """Whether ``text`` is a number of 0 or more: judged by its digits, so that neither underflow nor overflow matters."""
    m = NUMBER.fullmatch(text)
    return bool(m) and (m[1] != "-" or not m[2].strip("0."))


class Parser:
    """Recursive descent over ``text``, from anchor to anchor; ``lines`` says whether a newline outside quotes ends a record."""

    def __init__(self, text: str, anchors: Sequence[int], lines: bool = False):
        self.text, self.anchors, self.lines, self.pos, self.limit = text, anchors, lines, 0, 0
        self.bare = re.compile(r'[^",\r\n]*') if lines else BARE
        self.ends = ",\r\n" if lines else ","

    def field(self, to: Record) -> bool:
        text, start = self.text, self.pos
        quoted = start < self.limit and text[start] == '"'
        m = (QUOTED if quoted else self.bare).match(text, start, self.limit)
        if m:
            self.pos = m.end()
            to.fields.append(m[0] if not quoted else m[1].replace('""', '"') if '""' in m[1] else m[1])
        if not m or self.pos < self.limit and text[self.pos] not in self.ends:
            to.reason, to.at = "quoting", start if quoted else self.pos
            return False
        return True

    def record(self) -> Record:
        """The record at ``pos``; behind a broken one the parser stands at the next anchor."""
        to = Record(start=self.pos)
        if self.text.find('"', self.pos, self.limit) < 0:  # only bare fields up to the anchor
            m = NEWLINE.search(self.text, self.pos, self.limit) if self.lines else None
            self.pos = m.start() if m else self.limit
            to.fields = self.text[to.start : self.pos].split(",")
        else:
            while self.field(to) and self.pos < self.limit and self.text[self.pos] == ",":
                self.pos += 1
            if to.reason:
                self.pos = self.limit
        to.end = self.pos
        return judge(to)

    def __iter__(self) -> Iterator[Record]:
        for self.pos, self.limit in zip(self.anchors, [*self.anchors[1:], len(self.text)]):
            yield self.record()
            while self.lines and self.pos < self.limit:
                self.pos = NEWLINE.match(self.text, self.pos, self.limit).end()
                if self.pos < self.limit:
                    yield self.record()


def parse_text(text: str) -> Iterator[Record]:
    """The records of a file's text."""
    return iter(Parser(text, [0, *(m.start() for m in ANCHOR.finditer(text))], lines=True)) if text else iter(())


def judge(record: Record) -> Record:
    """Gives the record the first reason that applies, and the place of the field at fault."""
    if record.reason:
        return record
    f = record.fields
    if len(f) != len(COLUMNS):
        record.reason, record.at = "columns", record.start
        return record
    items = [x for x in (x.strip(BLANKS) for x in f[AMOUNTS].split("|")) if x]
    fee, port = f[FEE].strip(BLANKS), f[PORT].strip(BLANKS)
    if not items or not all(map(amount, items)):
        record.reason = "input_amounts"
    elif fee.lower() not in WORDS and not amount(fee):
        record.reason = "fee"
    elif port.lower() not in WORDS and not ((m := PORT_NUMBER.fullmatch(port)) and (len(d := m[1].lstrip("0")) < 6 and int(d or 0) <= 65535)):
        record.reason = "src_port"
    if record.reason:
        record.at = record.start + sum(len(x) + 1 for x in f[: COLUMNS.index(record.reason)])
    return record


def parse_delivered(lines: Sequence[str | None]) -> list[Record]:
    """Delivered lines as one text in which each line's start is an anchor; ``at`` counts from there. A carriage return at the very end of a line is not part of it; a null line has no columns."""
    given = [x[:-1] if x.endswith("\r") else x for x in lines if x is not None]
    parsed = iter(Parser("".join(given), [0, *accumulate(map(len, given[:-1]))])) if given else iter(())
    out = []
    for x in lines:
        record = next(parsed) if x is not None else Record(reason="columns", at=0)
        if record.at is not None:
            record.at -= record.start
        out.append(record)
    return out


def parse_line(line: str | None) -> Record:
    return parse_delivered([line])[0]


PARSED = T.StructType([T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType()), T.StructField("at", T.IntegerType())])


def to_arrow(records: list[Record]) -> pa.StructArray:
    flat, offsets = [], [0]
    for r in records:
        flat += r.fields
        offsets.append(len(flat))
    return pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.string())),
            pa.array([r.reason for r in records], pa.string()),
            pa.array([r.at for r in records], pa.int32()),
        ],
        ["fields", "reason", "at"],
    )


@F.arrow_udf(PARSED)
def parsed_line(lines: pa.Array) -> pa.Array:
    return to_arrow(parse_delivered(lines.to_pylist()))


parsed_line = parsed_line.asNondeterministic()  # so that a filter on its result doesn't make the optimizer parse twice


def parse_lines(df: DataFrame, key: str, line: str) -> DataFrame:
    """``key`` and the parsed record (``fields``, ``reason``, ``at``) of each row's line: rows stay where they are, nothing is shuffled.

    A null, empty or blank line is a row with reason ``columns``; a very long line is one row; other columns are not read.
    """
    return df.select(F.col(key).alias("k"), parsed_line(F.col(line)).alias("r")).select(F.col("k").alias(key), "r.fields", "r.reason", "r.at")


def rejected(parsed: DataFrame, key: str) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select(key, "reason")


def loaded(parsed: DataFrame, key: str) -> DataFrame:
    """The valid records as typed transactions; lists stay ordered arrays, missing words become null."""
    at = lambda name: F.trim(F.regexp_replace(F.get("fields", F.lit(COLUMNS.index(name))), r"^\t+|\t+$", ""))
    given = lambda name: F.when(~F.lower(at(name)).isin(*WORDS), at(name))
    listed = lambda name: F.filter(F.transform(F.split(at(name), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    numbers = lambda name: F.transform(listed(name), lambda x: x.try_cast("double"))
    return parsed.where(F.col("reason").isNull()).select(
        key,
        F.try_to_timestamp(F.regexp_replace(at("timestamp"), "T", " ")).cast("timestamp_ntz").alias("ts"),
        given("src_ip").alias("src_ip"),
        given("dst_ip").alias("dst_ip"),
        given("src_port").try_cast("double").cast("int").alias("src_port"),
        given("dst_port").try_cast("double").cast("int").alias("dst_port"),
        given("txid").alias("txid"),
        listed("input_addresses").alias("input_addresses"),
        listed("output_addresses").alias("output_addresses"),
        numbers("input_amounts").alias("input_amounts"),
        numbers("output_amounts").alias("output_amounts"),
        given("fee").try_cast("double").alias("fee"),
        F.upper(given("script_type")).alias("script_type"),
        F.upper(given("geo_country")).alias("geo_country"),
    )


def read_files(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Whole ledger files, records over several lines included: ``file_name``, ``at_byte`` (where the piece of the file begins), ``record_no`` within it, ``fields``, ``reason``, ``at``.

    Files are cut into byte ranges, so a large file is many tasks' work: a range's piece begins at the first anchor in it and ends at the first anchor behind it. A task holds its piece. A
    range without an anchor has no piece; the one before it takes its bytes.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                begin, content = piece(name, length, start, split)
                block, first = [], 0
                for record in parse_text(content.decode("utf-8", "replace")):
                    block.append(record)
                    if len(block) == 10_000:
                        yield pack(name, begin, first, block)
                        block, first = [], first + len(block)
                if block:
                    yield pack(name, begin, first, block)

    def pack(name: str, begin: int, first: int, block: list[Record]) -> pa.RecordBatch:
        s, n = to_arrow(block), len(block)
        return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([begin] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), *s.flatten()], ["file_name", "at_byte", "record_no", "fields", "reason", "at"])

    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start"))
    return ranges.repartition("path", "start").mapInArrow(batches, "file_name string, at_byte long, record_no long, fields array<string>, reason string, at int")


def piece(name: str, length: int, start: int, split: int) -> tuple[int, bytes]:
    """Where the piece of the range from ``start`` begins, and its bytes (none if no anchor lies in the range)."""
    system, path = FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file:///") else name)
    back = min(start, 1)  # an anchor is known by the newline before it
    with system.open_input_file(path) as f:
        f.seek(start - back)
        buffer = f.read(split + back)
        begin = 0
        if start:
            more = f.read(AHEAD)  # a beginning that the range's end cuts through
            m = ANCHOR_BYTES.search(buffer + more)
            if not m or m.start() >= back + split:
                return start, b""
            begin, buffer = m.start(), buffer + more
        at = back + split
        while start - back + len(buffer) < length and not ANCHOR_BYTES.search(buffer, max(at - 1, 0)):
            at = max(at, buffer.rfind(b"\n") + 1)  # the last line may be cut
            buffer += f.read(AHEAD)
        m = ANCHOR_BYTES.search(buffer, back + split)
    return start - back + begin, buffer[begin : m.start() if m else len(buffer)]
