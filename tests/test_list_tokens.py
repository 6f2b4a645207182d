"""Lists in differing notation."""

import random

import pytest

from tracewell.operators.list_tokens import list_rows, tokens


@pytest.mark.parametrize(
    "cell, items",
    [
        ("a1", ["a1"]),
        ("a|b;c/d\te\nf,g", list("abcdefg")),
        ("a ｜ b || c", ["a", "b", "c"]),
        (" ;a|", ["a"]),
        ('["a", "b"]', ["a", "b"]),
        ("[0.1, 0.2]", ["0.1", "0.2"]),
        ("'x'|'y'", ["x", "y"]),
        ('"0.5;0.6"', ["0.5", "0.6"]),
        ('"1,501.26"', ["1,501.26"]),
        ('"1472.32","2,432.8478","442.37"', ["1472.32", "2,432.8478", "442.37"]),
        ("1,501", ["1", "501"]),
        ("[1,501]", ["1", "501"]),
        ('"1,234,567.8"|2', ["1,234,567.8", "2"]),
        ('"1abc9,3def"', ["1abc9", "3def"]),
        ("2.274e-02|1e+3", ["2.274e-02", "1e+3"]),
        ("nan", []),
        ("None", []),
        ("", []),
        ("  ", []),
        ('""', []),
        ("nan|0.5|None", ["0.5"]),
        ('"open|b', ["open", "b"]),
        (r"a\|b|c", ["a|b", "c"]),
        ("[[a],[b,c]]", ["a", "b", "c"]),
    ],
)
def test_notations(cell, items):
    assert tokens(cell) == items


def test_round_trip_over_notations():
    rng = random.Random(2)
    for _ in range(300):
        items = [f"{rng.uniform(0, 999):.8f}" for _ in range(rng.randrange(1, 6))]
        quote = rng.choice(["", '"', "'"])
        cell = rng.choice(["|", ";", "/", "\t", " | ", " ,", "||"]).join(f"{quote}{x}{quote}" for x in items)
        cell = rng.choice(["%s", "[%s]", " %s ", "%s|"]) % cell
        assert tokens(cell) == items, cell


def test_tables(spark):
    df = spark.createDataFrame([(1, "a|b", None, "x"), (1, "a|b", None, "x"), (2, "", "z|" * 20000, "y"), (None, None, None, None)], "row_idx long, f string, g string, item string")
    rows = list_rows(df, ["row_idx"], ["f", "g"])
    got = [tuple(r) for r in rows.where("row_idx = 1").collect()]
    assert sorted(got) == [(1, "f", 1, "a"), (1, "f", 1, "a"), (1, "f", 2, "b"), (1, "f", 2, "b")]
    assert rows.where("row_idx = 2 AND field_name = 'g'").count() == 20000
    assert rows.where("row_idx IS NULL").count() == 0
    assert list_rows(df.limit(0), ["row_idx"], ["f", "g"]).count() == 0
