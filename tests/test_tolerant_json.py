"""The tolerant reader: golden cases, standard documents unchanged, and any cut leaves what was complete."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.functions import tolerant_json as J
from quillgraph.operators import questions as Q

GOLDEN = [
    ("{'a': 'it''s', 'b': [1, 2,],}", {"a": "it''s", "b": [1, 2]}),
    ("{'a': 'don't stop', 'b': 2}", {"a": "don't stop", "b": 2}),
    ('{"say": "he said "yes" twice", "n": 1}', {"say": 'he said "yes" twice', "n": 1}),
    ("{a: 1, b_c: two words, d: true, e: None, f: .5, g: 0x1F, h: -3e2}", {"a": 1, "b_c": "two words", "d": True, "e": None, "f": 0.5, "g": 31, "h": -300.0}),
    ('{"a": 1 // one\n, /* two */ "b": 2, # three\n "c": 3}', {"a": 1, "b": 2, "c": 3}),
    ('{"a": "x"\n "b": "y" "c": [1 2]}', {"a": "x", "b": "y", "c": ["1 2"]}),
    ('{"url": "http://x.y/z#t", "a": "1, 2: {3}"', {"url": "http://x.y/z#t", "a": "1, 2: {3}"}),
    ('{"a": [1, {"b": "cut her', {"a": [1, {"b": "cut her"}]}),
    ('{"a": 1, "b": tru', {"a": 1, "b": True}),
    ('{"a": 1, "b":', {"a": 1}),
    ('{"a": 1, "b', {"a": 1}),
    ("Sure! Here it is: [1, 'two', {three: 3}] and more {x}", [1, "two", {"three": 3}]),
    ("```json\n{'k': “v”}\n```", {"k": "v"}),
    ('{"a": [1, 2}, "b": 3', {"a": [1, 2]}),
    ("{'u': '\\u00e9\\n\\'', 'p': '\\ud83d\\ude00'}", {"u": "é\n'", "p": "😀"}),
    ("]{", None),
    ("{,,:}", None),
    ("nothing", None),
    ("", None),
]


@pytest.mark.parametrize("text,want", GOLDEN)
def test_golden(text, want):
    assert J.parse(text)[0] == want


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda v: st.lists(v) | st.dictionaries(st.text(), v), max_leaves=20)


@settings(max_examples=300, deadline=None)
@given(VALUES)
def test_standard_documents_are_unchanged(value):
    assert J.parse(json.dumps(value)) == (value, "strict")


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1), st.lists(st.integers() | st.text("xyz ',:{}[]\"\\\n")), min_size=1), st.data())
def test_a_cut_never_crashes_and_keeps_what_was_complete(value, data):
    text = json.dumps(value)
    cut = text[: data.draw(st.integers(0, len(text)))]
    found = J.tolerant(cut)
    if found:
        keys = list(value)
        for key in list(found)[:-1]:
            assert key in keys and len(found[key]) == len(value[key])


@settings(max_examples=300, deadline=None)
@given(st.text("{}[]\"':,\\ \n/*#ab1“”", max_size=60))
def test_any_text_is_read(text):
    J.parse(text)
    J.listed(text, "a")


def test_deep_nesting_is_no_recursion():
    depth = 50_000
    found = J.tolerant("[" * depth)
    for _ in range(depth - 1):
        found = found[0]
    assert found == []


def test_lists_with_fallbacks():
    assert J.listed('{"facts": [" a ", "", {"f": 1}, 3]}', "facts") == ["a", {"f": 1}]
    assert J.listed("The facts: [ 'one', \"two\" , ] ok", "facts") == ["one", "two"]
    assert J.listed("none", "facts") == [] and J.listed('{"facts": "no list"}', "facts") == []


def test_over_a_table(spark):
    rows = spark.createDataFrame([(1, "{'a': 1,}", "x"), (2, None, "x"), (3, "[1]", "x")], "id long, raw string, how string")
    assert {(r.id, r.json, r.how) for r in Q.repaired(rows, "raw").collect()} == {(1, '{"a": 1}', "repaired"), (2, None, "none"), (3, "[1]", "strict")}
