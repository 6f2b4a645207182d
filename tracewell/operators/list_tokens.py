"""Several values packed in one field: a quote-aware finite-state tokenizer.

The machine reads a cell once. A lexer (one regular expression, so a finite automaton) names each run of
characters: value, separator, comma, quote, bracket, escape. The state is the open quote, the bracket depth and the item so far:

* a separator, a blank or a bracket ends the item, inside quotes too (``"a;b"`` holds two values: here whole lists stand in quotes, so the method's
  rule that only delimiters outside quotes count would give wrong items);
* a comma ends it as well, except between digits of a number inside quotes, where it groups digits (``"1,501.26"``);
* quotes and brackets are never part of a value; a backslash makes the next character part of the value;
* an unclosed quote or bracket ends with the cell.

Empty places give no value and take no position. The words in ``MISSING`` stand for a missing value.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words for a missing value, compared in lower case.
MISSING = frozenset({"nan", "none"})

LEXER = re.compile(
    r"(?P<value>[^\s|;,/\\｜¦'\"“”‘’`\[\](){}<>]+)|(?P<comma>,)|(?P<gap>[\s|;/｜¦]+)|(?P<quote>['\"“”‘’`])|(?P<bracket>[\[\](){}<>])|\\(?P<escaped>.?)",
    re.DOTALL,
)
NUMBER_SO_FAR = re.compile(r"[+-]?[0-9][0-9.,eE+-]*")
CLOSER = {"“": "”", "‘": "’"}


def tokens(cell: str) -> list[str]:
    """The values of one cell, in order."""
    found, item, quote, depth = [], "", "", 0
    for m in LEXER.finditer(cell):
        kind = m.lastgroup
        if kind == "value":
            item += m[0]
            continue
        if kind == "escaped":
            item += m[kind]
            continue
        if kind == "comma" and quote and item[-1:].isdigit() and cell[m.end() : m.end() + 1].isdigit() and NUMBER_SO_FAR.fullmatch(item):
            item += ","
            continue
        if kind == "quote":
            if not quote:
                quote = CLOSER.get(m[0], m[0])
            elif m[0] == quote:
                quote = ""
            continue
        if kind == "bracket":
            depth += 1 if m[0] in "[({<" else -1
            if depth <= 0:
                depth, quote = 0, ""  # the end of the list closes what is open
        if item:
            found.append(item)
            item = ""
    if item:
        found.append(item)
    return [x for x in found if x.lower() not in MISSING] if found else found


@F.arrow_udf(T.ArrayType(T.StringType()))
def list_items(cells: pa.Array) -> pa.Array:
    """The values of each cell as an array; a null cell gives an empty array."""
    values, offsets = [], [0]
    for cell in cells.to_pylist():
        if cell:
            values += tokens(cell)
        offsets.append(len(values))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.string()))


list_items = list_items.asNondeterministic()  # so that a filter on its result doesn't make the optimizer tokenize twice

#: Cells that any notation reads alike: values of letters, digits, points and signs, parted by ``|``, without a blank or a quote.
PLAIN = r"^[0-9A-Za-z.+|_-]*$"


def any_items(cell: str | Column) -> Column:
    """As ``list_items``, but plain pipe lists are split by an expression; only cells in other notations go through Python."""
    x = (F.col(cell) if isinstance(cell, str) else cell).cast("string")
    plain = F.coalesce(x.rlike(PLAIN), F.lit(True))
    split = F.filter(F.split(F.coalesce(x, F.lit("")), r"\|"), lambda v: ~F.lower(v).isin("", *sorted(MISSING)))
    return F.when(plain, split).otherwise(list_items(F.when(~plain, x)))


def list_rows(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row for each value in the list cells ``fields``: the key columns, ``field_name``, ``pos`` from 1, ``item``.

    Null, empty and blank cells give no row; other columns of ``df``, whatever their names, are not read. Repeated rows
    give repeated rows. A cell is one task's work however long it is; nothing is shuffled.
    """
    packed = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[list_items(F.col(f)).alias(f"f{i}") for i, f in enumerate(fields)])
    every = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"f{i}").alias("items")) for i, f in enumerate(fields)])
    cells = packed.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.inline(every))
    rows = cells.select(*keys, "field_name", F.posexplode("items").alias("at", "item"))
    return rows.select(*keys, "field_name", (F.col("at") + 1).alias("pos"), "item")


def lower_items(cell: str | Column) -> Column:
    """The distinct values of a list cell in lower case."""
    return F.array_distinct(F.transform(list_items(F.col(cell) if isinstance(cell, str) else cell), F.lower))
