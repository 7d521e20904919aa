from __future__ import annotations

import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scanloom.operators.packed_values import split_packed, split_values

CASES = {
    '1. Alpha\n2. "Beta ""forte"", 49 mg"\n3. Gamma 32.8 ml': ["Alpha", 'Beta "forte", 49 mg', "Gamma 32.8 ml"],
    "1) A slow 2) B 14.7 mcg 3) C": ["A slow", "B 14.7 mcg", "C"],
    "«ا، ب»،ج ٢٧,٦ غرام؛؛ د": ["ا، ب", "ج ٢٧,٦ غرام", "د"],
    "A 5,5 mg,B": ["A 5,5 mg", "B"],
    "A/B 7/73 mg / C 24 g": ["A/B 7/73 mg", "C 24 g"],
    "* a\n* b\n- c": ["a", "b", "c"],
    " • x • y •": ["x", "y"],
    '"a; b"|c': ["a; b", "c"],
    '5" tube, gauze': ['5" tube', "gauze"],
    "stage 3 disease": ["stage 3 disease"],
    "": [],
    " ; ,\n": [],
}


def rows_of(values):
    parent, position, items = split_packed(pa.array(values, pa.string()))
    out = [[] for _ in values]
    for row, pos, item in zip(parent, position, items.to_pylist()):
        out[row].append(item)
        assert pos == len(out[row])
    return out


def test_cases_alone_and_in_one_buffer():
    assert rows_of(list(CASES)) == list(CASES.values())
    for text, expected in CASES.items():
        assert rows_of([text, None]) == [expected, []]


def brute(text: str) -> list[str]:
    """Character by character, for the delimiters and straight quotes only."""
    if text.count('"') % 2:
        quotes = False
    else:
        quotes = True
    items, current, inside = [], "", False
    for k, c in enumerate(text):
        if c == '"' and quotes:
            inside = not inside
        between = 0 < k < len(text) - 1 and text[k - 1].isdigit() and text[k + 1].isdigit()
        if not inside and (c in ";|\n،؛" or (c == "," and not between)):
            items.append(current)
            current = ""
        else:
            current += c
    items.append(current)
    out = []
    for item in (x.strip(" \n") for x in items):
        if len(item) > 1 and item[0] == item[-1] == '"':
            item = item[1:-1].replace('""', '"').strip(" \n")
        if item:
            out.append(item)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab7 "",;|\n،؛ز', max_size=25), max_size=6))
def test_against_brute_force(texts):
    assert rows_of(texts) == [brute(t) for t in texts]


def test_sliced_array():
    whole = pa.array(["zz;zz", "a;b", None, "c"])
    parent, _, items = split_packed(whole.slice(1, 3))
    assert parent.tolist() == [0, 0, 2] and items.to_pylist() == ["a", "b", "c"]


def test_operator_nulls_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a; b", 9, "x"), (2, None, 8, "y"), (None, "c|d", 7, "z"), (3, "", 6, "w"), (4, "one", 5, "v")], "record_id bigint, f string, pos int, item string")
    got = {tuple(r) for r in split_values(df, "record_id", "f").collect()}
    assert got == {(1, "f", 1, "a"), (1, "f", 2, "b"), (None, "f", 1, "c"), (None, "f", 2, "d"), (4, "f", 1, "one")}
    assert split_values(df, "record_id", "f", only_packed=True).where("record_id = 4").count() == 0
    assert split_values(df.limit(0), "record_id", "f").count() == 0
    long = df.limit(1).select("record_id", F.expr("repeat('ab; ', 200000)").alias("f"))
    assert split_values(long, "record_id", "f").count() == 200000


def test_bytes_are_kept():
    text = "É; ⅷ | 日本，語 ; 🙂"
    assert "".join(rows_of([text])[0]) == re.sub(r"\s*[;|]\s*", "", text)


def test_bullets_after_any_number_of_spaces():
    _, position, items = split_packed(pa.array(["* one\n" + " " * 9 + "* two\n    - three", "a *b\nc"], pa.string()))
    assert items.to_pylist()[:3] == ["one", "two", "three"] and list(position)[:3] == [1, 2, 3] and "a *b" in items.to_pylist()
