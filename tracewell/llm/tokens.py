"""Encoding of a whole corpus with a public byte-level BPE tokenizer: a streaming transducer with bounded lookahead.

A text is read in blocks, whatever its length, and the ids of a block are emitted once they are stable. Two bounds keep what is held constant. The pre-tokenizer's pattern never joins a visible
character with a blank behind it, so a block ends at such a place. Where a block has none (scripts without blanks, long runs), the text goes on pre-token by pre-token; and within a
pre-token longer than a block, the merge list itself bounds how far to the right a merge can depend on what follows (``lookahead``): tokens that end
that far before the end of what has been read can't change any more; they are emitted, and encoding goes on behind them, since the encoding of a text that starts at a
token boundary doesn't depend on what lies before it (Berglund & van der Merwe, 2023). The merges within a block are done by the installed library.
"""

from __future__ import annotations

import base64
import codecs
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern that splits texts into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1 << 12  # characters of a block; bytes of a long pre-token read at once


@lru_cache(4)
def vocabulary(path: str) -> bytes:
    return Path(path).read_bytes()


def ranks_of(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


def merge_rules(ranks: dict[bytes, int]) -> dict[int, tuple[bytes, bytes]]:
    """The pair each token is merged from, by rank: what its bytes are merged to when only lower ranks are allowed."""
    rules = {}
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            rules[rank] = (parts[0], parts[1])
    return rules


def lookahead(rules: dict[int, tuple[bytes, bytes]]) -> int:
    """Bytes to the right that can bear on whether a token boundary stands.

    A merge (x, y) of rank r fails on its right side only if the last part of y (y, its right child, and so on) is taken by a merge with what follows, of a rank below the
    one by which that part joins the left; that merge depends in turn on lower ranks further right. Ranks fall along such a chain, so the longest chain follows from the rules in
    order of rank.
    """
    right: dict[bytes, tuple[int, bytes]] = {}
    under: dict[bytes, tuple[list[int], list[int]]] = {}  # part to the ranks that take it to the right, and the longest reach up to each
    longest = 0
    for rank in sorted(rules):
        x, y = rules[rank]
        reach, part, limit = 0, y, rank
        while True:
            if part in under and (i := bisect_left(under[part][0], limit)):
                reach = max(reach, under[part][1][i - 1])
            if part not in right:
                break
            limit, part = right[part]
        taken = under.setdefault(x, ([], []))
        taken[0].append(rank)
        taken[1].append(max(len(y) + reach, taken[1][-1] if taken[1] else 0))
        right[x + y] = (rank, y)
        longest = max(longest, len(y) + reach)
    return longest


@lru_cache(4)
def lookahead_of(path: str) -> int:
    return lookahead(merge_rules(ranks_of(vocabulary(path))))


class Transducer:
    """Texts to ids. ``block`` and ``ahead`` bound what is held besides the text and its ids."""

    def __init__(self, content: bytes, ahead: int, block: int = BLOCK):
        import regex
        import tiktoken

        self.ranks = ranks_of(content)
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.length = {i: len(t) for t, i in self.ranks.items()}
        # white space as the library's pattern has it, not as Python does
        own = PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.pattern, self.ahead, self.block = regex.compile(own), ahead, max(block, 4 * ahead)

    def pieces(self, piece: bytes) -> Iterator[list[int]]:
        """Ids of one long pre-token, emitted once they are stable."""
        pos = 0
        while pos < len(piece):
            chunk = piece[pos : pos + self.block]
            ids = self.encoding._encode_single_piece(chunk)
            if pos + len(chunk) < len(piece):
                stable, end = len(chunk) - self.ahead, 0
                for n, i in enumerate(ids):
                    if end + self.length[i] > stable:
                        ids = ids[:n]
                        break
                    end += self.length[i]
                pos += end
            else:
                pos = len(piece)
            yield ids

    def boundary(self, text: str, start: int, end: int) -> int:
        """The last place up to ``end`` where a blank stands behind a visible character; 0 if there is none behind ``start``."""
        at = end + 1
        while at > start:
            at = max(text.rfind(" ", start + 1, at), text.rfind("\n", start + 1, at))
            if at > start and not text[at - 1].isspace():
                return at
        return 0

    def stream(self, text: str) -> Iterator[list[int]]:
        start = 0
        while start < len(text):
            end = start + self.block
            at = len(text) if end >= len(text) else self.boundary(text, start, end)
            if at:
                yield self.encoding.encode_ordinary(text[start:at])
                start = at
                continue
            m = self.pattern.match(text, start)
            piece = m[0].encode("utf-8", "replace")
            if len(piece) > self.block:
                yield from self.pieces(piece)
            else:
                yield self.encoding._encode_single_piece(piece)
            start = m.end()

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; the empty list for an empty and for a null text. Special tokens' strings are ordinary text."""
        return [i for ids in self.stream(text) for i in ids] if text else []


class Decoder:
    """Ids to text, piece by piece: a state machine over bytes that holds at most the three bytes of an unfinished character."""

    def __init__(self, content: bytes):
        self.bytes_of = {i: t for t, i in ranks_of(content).items()}

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if out := state.decode(self.bytes_of[i]):
                yield out
        if out := state.decode(b"", True):
            yield out

    def decode(self, ids: Iterable[int] | None) -> str:
        return "".join(self.stream(ids or ()))


def vocabulary_file(name: str = "byte_bpe_50k", folder: str = FOLDER) -> str:
    return f"{folder}/{name}.tiktoken"


def encoded(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` of every row, in place: no shuffle, one Arrow batch at a time. The vocabulary (under 1 MB) travels with the tasks.

    A null and an empty text have the empty list; keys may be null or repeated, equal rows come out equally often; a text is read in blocks, but its ids are one cell of the result. Other columns are not read; an empty
    table gives no row.
    """
    return with_ids(df.select(key, text), path or vocabulary_file(), "ids array<int>", lambda ids: pa.array(ids, pa.list_(pa.int32())))


def counted(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key`` and the number of tokens, ``n_tokens``, of every row."""
    return with_ids(df.select(key, text), path or vocabulary_file(), "n_tokens int", lambda ids: pa.array(list(map(len, ids)), pa.int32()))


def with_ids(rows: DataFrame, path: str, column: str, build) -> DataFrame:
    content, ahead, name = rows.sparkSession.sparkContext.broadcast(vocabulary(path)), lookahead_of(path), column.split()[0]
    key = rows.columns[0]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = Transducer(content.value, ahead)
        for batch in it:
            texts = batch.column(1)
            for at in range(0, len(texts), 1000):
                some = texts.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1000), build([transducer.encode(t) for t in some.to_pylist()])], [key, name])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, {column}")


def decoded(rows: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """``key`` and the ``text`` of the ids; the empty text for no ids or null. Ids outside the vocabulary fail."""
    content = rows.sparkSession.sparkContext.broadcast(vocabulary(path or vocabulary_file()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(content.value)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decoder.decode(x) for x in batch.column(1).to_pylist()], pa.string())], [key, "text"])

    chosen = rows.select(key, F.col(ids).cast("array<int>"))
    return chosen.mapInArrow(run, f"`{key}` {chosen.schema[0].dataType.simpleString()}, text string")
