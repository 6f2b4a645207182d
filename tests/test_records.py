"""Lines that fail to parse: the grammar, its reasons, recovery and edge cases."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.operators import records as R

GOOD = '2026-07-01 00:00:01,10.0.0.1,10.0.0.2,8333,8333,tx1,A|B,C,0.1|0.2,0.3,0.001,P2PKH,US'


def with_field(i, value):
    f = GOOD.split(",")
    f[i] = value
    return ",".join(f)


@pytest.mark.parametrize(
    "line, reason",
    [
        (GOOD, None),
        (GOOD + "\r", None),
        (with_field(11, '"P2WSH, 2-of-3"'), None),
        (with_field(11, '"two\nlines"'), None),
        (with_field(11, '"say ""x"""'), None),
        (with_field(11, '"open'), "quoting"),
        (with_field(11, '"closed" late'), "quoting"),
        (with_field(11, 'in"side'), "quoting"),
        (with_field(11, ' "after blank"'), "quoting"),
        (GOOD + ",more", "columns"),
        ("", "columns"),
        ("   ", "columns"),
        (None, "columns"),
        ("EOF", "columns"),
        (with_field(8, ""), "input_amounts"),
        (with_field(8, " | |"), "input_amounts"),
        (with_field(8, "0.1| |0.2"), None),
        (with_field(8, "-1"), "input_amounts"),
        (with_field(8, "-0.0"), None),
        (with_field(8, "1e400"), None),
        (with_field(8, "-1e-400"), "input_amounts"),
        (with_field(8, "nan"), "input_amounts"),
        (with_field(8, "1_0"), "input_amounts"),
        (with_field(8, "5.|.5|+1e3"), None),
        (with_field(8, "."), "input_amounts"),
        (with_field(8, "1.2.3"), "input_amounts"),
        (with_field(8, "٣"), "input_amounts"),
        (with_field(10, "NaN"), None),
        (with_field(10, ""), None),
        (with_field(10, "-0.1"), "fee"),
        (with_field(10, "free"), "fee"),
        (with_field(3, " \t8333.00\t"), None),
        (with_field(3, "65535"), None),
        (with_field(3, "65536"), "src_port"),
        (with_field(3, "+80"), "src_port"),
        (with_field(3, "80.5"), "src_port"),
        (with_field(3, "8e3"), "src_port"),
        (with_field(3, "9" * 5000), "src_port"),
        (with_field(3, "None"), None),
        (with_field(8, "x").replace(",0.001,", ",bad,"), "input_amounts"),
    ],
)
def test_reasons(line, reason):
    assert R.parse_line(line).reason == reason


def test_agrees_with_the_csv_module_on_sound_lines():
    rng = random.Random(1)
    for _ in range(300):
        fields = ["".join(rng.choice('ab ,"\n|') for _ in range(rng.randrange(6))) for _ in range(13)]
        out = io.StringIO()
        csv.writer(out, lineterminator="", quoting=csv.QUOTE_ALL).writerow(fields)
        assert R.parse_line(out.getvalue()).fields == fields


def test_resumes_at_the_next_record_start():
    broken = with_field(11, '"open')
    text = "\n".join([GOOD, broken, GOOD, "junk", GOOD])
    got = list(R.parse_text(text))
    assert [r.reason for r in got] == [None, "quoting", None, "columns", None]
    assert text[got[1].at] == '"'


def test_a_quoted_field_may_span_lines_in_a_file():
    text = "\r\n".join([with_field(11, '"a\nb"'), GOOD])
    assert [r.reason for r in R.parse_text(text)] == [None, None]


def test_later_quotes_do_not_hide_records():
    text = "\n".join([with_field(11, '"lost'), GOOD, GOOD, with_field(11, '"P2WSH, 2-of-3"'), GOOD])
    got = list(R.parse_text(text))
    assert [r.reason for r in got] == ["quoting", None, None, None, None]
    assert got[0].at == text.index('"lost')


@given(st.integers(1, 12), st.data())
@settings(max_examples=150, deadline=None)
def test_one_broken_quote_costs_one_record(n, data):
    """n records, others quoted at random, a quote dropped from one of them or put into it: n come out, and only that one is broken."""
    fields = [GOOD.split(",") for _ in range(n)]
    for f in fields:
        f[5] = f"tx{data.draw(st.integers(0, 99))}"
        for i in data.draw(st.sets(st.sampled_from([5, 6, 11, 12]))):
            f[i] = '"' + f[i] + data.draw(st.sampled_from(["", ", more", "\nnext line", '""said""', "\r\n"])) + '"'
    bad = data.draw(st.integers(0, n - 1))
    kind = data.draw(st.sampled_from(["none", "unclosed", "inside", "late"]))
    at = data.draw(st.sampled_from([5, 6, 11, 12]))
    if kind != "none":
        fields[bad][at] = {"unclosed": '"lost', "inside": 'in"side', "late": '"closed" late'}[kind]
    text = data.draw(st.sampled_from(["\n", "\r\n"])).join(",".join(f) for f in fields)
    got = list(R.parse_text(text))
    assert len(got) == n
    assert [i for i, r in enumerate(got) if r.reason] == ([] if kind == "none" else [bad])


def test_delivered_lines_are_anchors():
    lines = [GOOD, with_field(11, '"open'), None, "", GOOD + "\r", with_field(11, '"two\nlines"'), 'x"', GOOD]
    got = R.parse_delivered(lines)
    assert [r.reason for r in got] == [None, "quoting", "columns", "columns", None, None, "quoting", None]
    assert got[1].at == lines[1].index('"') and got[6].at == 1
    assert R.parse_delivered([]) == []


def test_tables(spark):
    rows = [(1, GOOD, "x"), (2, None, "y"), (2, None, "y"), (3, with_field(8, "0.5|" * 5000), None), (None, "EOF", None)]
    df = spark.createDataFrame(rows, "line_id long, raw_line string, reason string")
    parsed = R.parse_lines(df, "line_id", "raw_line")
    assert sorted((r.line_id or 0, r.reason) for r in R.rejected(parsed, "line_id").collect()) == [(0, "columns"), (2, "columns"), (2, "columns")]
    good = {r.line_id: r for r in R.loaded(parsed, "line_id").collect()}
    assert good[1].input_amounts == [0.1, 0.2] and good[1].fee == 0.001 and good[1].src_port == 8333 and str(good[1].ts) == "2026-07-01 00:00:01"
    assert len(good[3].input_amounts) == 5000
    assert R.parse_lines(df.limit(0), "line_id", "raw_line").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([GOOD, with_field(11, '"open'), GOOD]))
    (tmp_path / "empty.csv").write_text("")
    got = R.read_files(spark, str(tmp_path)).orderBy("record_no").collect()
    assert [r.reason for r in got] == [None, "quoting", None] and [r.record_no for r in got] == [0, 1, 2]


@pytest.mark.parametrize("split", [1, 40, 150, 1000, 1 << 20])
def test_files_in_byte_ranges(spark, tmp_path, split):
    rows = [GOOD, with_field(11, '"open'), with_field(11, '"é, two\nlines"'), "junk é", with_field(5, "txé")] * 6
    (tmp_path / "a.csv").write_text("\n".join(rows), "utf-8")
    got = R.read_files(spark, str(tmp_path), split).orderBy("at_byte", "record_no").collect()
    assert [r.reason for r in got] == [None, "quoting", None, "columns", None] * 6
    assert [r.fields for r in got if r.reason is None] == [r.fields for r in R.parse_text("\n".join(rows)) if r.reason is None]
