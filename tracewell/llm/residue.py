"""Template residue and error-page text: message templates are mined, each is classified once, and its verdict propagated to all records that hold it.

1. Texts are cut into lines and sentences (units), and values (addresses, dates, numbers ...) are masked.
2. Units are sorted into a prefix tree of fixed depth (after He et al., Drain, 2017): by the number of tokens, then the leading tokens, then what is constant behind them. A token is variable unless a
   verdict may depend on it; so a leaf is one template, whatever the order in which its units come, matching is one look-up however many templates a branch has, and units that differ in a
   word that counts never share a template.
3. Templates, with the number of records that hold them, are aggregated in each task, then over all; each is classified once (``residue_rules.verdict``: wording rules, then a classifier fitted
   on labelled wordings): error, notice, filler or none.
4. Verdicts go back to the records by the templates' keys. Unresolved slots, whose sentences are ordinary otherwise, are found record by record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import residue_rules as rules
from tracewell.runtime import Scratch

DEPTH = 3  # leading tokens in the path to a leaf
FLUSH = 100_000  # forms that a task gathers before it passes them on

UNITS = re.compile(r"(?<=[.!?。।])\s+|[\n\r\v\f\x85\u2028\u2029]+")
#: A run of characters that may be a value: it starts with a digit, behind the letters of a reference, an address or a hexadecimal number at most.
VALUE = re.compile(r"(?<![<\w/.])(?:[Cc][Ff]-|[Bb][Cc]|[A-Fa-f]{1,12})?\d[\w.:…/-]*")
REF, DATE, ADDRESS = re.compile(r"CF-\d", re.I), re.compile(r"\d{4}-\d\d-\d\d|\d{1,2}\.\d\d\.\d{4}"), re.compile(r"(?:bc1|[13])(?=\w*[A-Za-z])\w{2,}")
IP4, IP6, HEX = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}"), re.compile(r"(?:[0-9a-f]{0,4}:){3,}[0-9a-f]*", re.I), re.compile(r"[0-9a-f]{8,}", re.I)
MONTHS = re.compile(r"⟨n⟩ (?:January|February|March|April|May|June|July|August|September|October|November|December)\b", re.I)
TAILS = ".,:;/-…"


def name_of(m: re.Match) -> str:
    """The kind of a value, with the punctuation behind it."""
    run = m[0]
    core = run.rstrip(TAILS)
    tail = run[len(core) :]
    if core.isdigit():
        kind = "⟨n⟩" if len(core) < 8 else "⟨hex⟩"
    elif len(core) < 14 and (core.count(".") == 1 and core.replace(".", "").isdigit() or core.count(":") == 1 and core.replace(":", "").isdigit()):
        kind = "⟨n⟩"
    elif REF.match(core):
        kind = "⟨ref⟩"
    elif DATE.match(core):
        kind = "⟨date⟩"
    elif IP4.match(core) or IP6.match(core):
        kind = "⟨ip⟩"
    elif HEX.fullmatch(core):
        kind = "⟨hex⟩"
    elif ADDRESS.match(core):
        kind = "⟨addr⟩"
    elif core.isalnum():
        kind = "⟨id⟩"
    else:
        kind = WHOLE.sub("⟨n⟩", core)
    return kind + tail


WHOLE = re.compile(r"\d+(?:[.:/-]\d+)*")
def masked(text: str) -> str:
    """A text with its values replaced by their kinds."""
    text = VALUE.sub(name_of, text)
    return MONTHS.sub("⟨date⟩", text) if "⟨n⟩ " in text else text


def forms_of(text: str | None) -> tuple[set[str], bool]:
    """The masked forms of a text's lines and sentences, and whether it holds an unfilled slot."""
    if not text or text.isspace():
        return set(), False
    text = rules.clean(text)
    slot = bool(rules.HINT.search(text)) and any(map(rules.slot, UNITS.split(text)))
    forms = {" ".join(unit.split()) for unit in UNITS.split(masked(text))}
    forms.discard("")
    return forms, slot


FILLER = "⟨filler⟩"  # the template of all units that are filler by the look of their words


def template_of(form: str) -> tuple[str, str]:
    """The branch of a form in the tree, and its template."""
    if rules.mere_filler(form):
        return "", FILLER
    tokens = list(map(rules.constant, form.split()))
    return " ".join([str(len(tokens)), *(t.lower() for t in tokens[:DEPTH])]), " ".join(tokens)


def name(path: tuple[str, str]) -> int:
    """64 bits that stand for a leaf."""
    return int.from_bytes(blake2b("\0".join(path).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def verdict(template: str) -> str | None:
    return "filler" if template == FILLER else rules.verdict(template)


UNIT_COLUMNS = "h long, slot boolean, template string, n long"


def units(rows: DataFrame) -> DataFrame:
    """One pass over the texts (columns k, t): a row (``k``, ``h``) for each template of a text, a row with ``slot`` for a text with a slot, and, once per task, each template with its key ``h`` and the number ``n`` of
    the task's texts that hold it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}  # forms to keys
        mined: dict[int, list] = {}  # keys to template and number of texts

        def templates(kind: pa.DataType) -> pa.RecordBatch:
            n = len(mined)
            return pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.array(mined, pa.int64()), pa.nulls(n, pa.bool_()), pa.array([t for t, _ in mined.values()], pa.string()), pa.array([c for _, c in mined.values()], pa.int64())], names)

        kind = None
        for b in it:
            kind, at, hashes, slots = b.column(0).type, [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found, slot = forms_of(t)
                keys = set()
                for f in found:
                    h = seen.get(f)
                    if h is None:
                        path = template_of(f)
                        seen[f] = h = name(path)
                        mined.setdefault(h, [path[1], 0])
                    keys.add(h)
                for h in keys:
                    mined[h][1] += 1
                at += [i] * len(keys)
                hashes += keys
                if slot:
                    slots.append(i)
            n, m = len(at), len(slots)
            who = b.column(0).take(pa.array([*at, *slots], pa.int32()))
            yield pa.RecordBatch.from_arrays([who, pa.array([*hashes, *[None] * m], pa.int64()), pa.array([False] * n + [True] * m), pa.nulls(n + m, pa.string()), pa.nulls(n + m, pa.int64())], names)
            if len(seen) >= FLUSH:
                yield templates(kind)
                seen, mined = {}, {}
        if mined:
            yield templates(kind)

    names = ["k", "h", "slot", "template", "n"]
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, {UNIT_COLUMNS}")


def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates to the verdicts of those that are residue."""
    for b in it:
        kinds = pa.array([verdict(t) for t in b.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns, kinds], ["h", "template", "n", "kind"]).filter(kinds.is_valid())


def classified(units_: DataFrame) -> DataFrame:
    """``h``, ``template``, ``n`` (texts that hold it) and ``kind`` of the mined templates that are residue."""
    mined = units_.where("template IS NOT NULL").groupBy("h").agg(F.min("template").alias("template"), F.sum("n").alias("n"))
    return mined.mapInArrow(judge, "h long, template string, n long, kind string")


def residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``kinds`` (sorted array of error, filler, notice, slot) of each row whose text holds residue.

    Null, empty and blank texts are no residue; a long text is read whole; equal rows are one row. Other columns are not read. The texts are read once: the keys of their templates,
    64 bits each, and the templates of each task are written to the shared folder.
    """
    scratch = Scratch(df.sparkSession, "residue")
    all_ = scratch.cut(units(given(df, key, text)), "units")
    known = scratch.small(classified(all_).select("h", "kind"), "verdicts")
    found = all_.where("NOT slot").select("k", "h").join(known, "h").select("k", "kind")
    slots = all_.where("slot").select("k", F.lit("slot").alias("kind"))
    return found.unionByName(slots).groupBy("k").agg(F.sort_array(F.collect_set("kind")).alias("kinds")).select(F.col("k").alias(key), "kinds")


def given(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL")


def templates(df: DataFrame, key: str, text: str) -> DataFrame:
    """``template``, ``kind`` and ``n_records`` of the templates that are residue: what to look at before records are left out."""
    return classified(Scratch(df.sparkSession, "residue").cut(units(given(df, key, text)), "units")).select("template", "kind", F.col("n").alias("n_records"))
