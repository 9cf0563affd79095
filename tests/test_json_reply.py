import json

from hypothesis import given, settings
from hypothesis import strategies as st

from loamline.functions import json_reply as J
from pyspark.sql import functions as F


def slowly(text):
    """Balanced spans, one character at a time."""
    found, expected, start, quoted, escaped = [], [], 0, False, False
    for i, c in enumerate(text):
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            start = start if expected else i
            expected.append({"{": "}", "[": "]"}[c])
        elif c in "}]":
            if expected and c == expected[-1]:
                expected.pop()
                if not expected:
                    found.append(text[start : i + 1])
            else:
                expected.clear()
    return found


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='{}[]"\\ab,: \n', max_size=40))
def test_spans(text):
    assert J.balanced(text) == slowly(text)


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.integers() | st.text(alphabet='ab"{}[],:\\ ', max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet='ab"', max_size=3), x, max_size=3), max_leaves=8))
def test_well_formed_json_is_found_whole(value):
    text = json.dumps(value)
    assert J.with_inner_quotes_escaped(text) == text or isinstance(json.loads(J.values(text)[0]), type(value))
    if isinstance(value, (list, dict)):
        assert J.balanced(text) == [text]
        assert [json.loads(v) for v in J.values(f"first {text} last")] == [value]


def test_values():
    assert J.values('say\n```json\n{"a": 1}\n```') == ['{"a": 1}']
    assert J.values('```\nnot\n``` {"c": 2} and {"d": [3]}') == ['{"c": 2}', '{"d": [3]}']
    assert J.values('{"a": "he said "no" twice"}') == ['{"a": "he said \\"no\\" twice"}']
    assert J.values('```json\n{"open": 1}') == ['{"open": 1}']  # a fence that never ends
    assert J.values("5") == ["5"] and J.values("none") == J.values("") == J.values(None) == []
    assert J.values('{"a": 1} {"a": 1}') == ['{"a": 1}']
    assert J.values("[" * 100_000) == []


def test_in_batches(spark):
    cases = {'x {"b": [1]} y': ['{"b": [1]}'], "none": [], "": [], '{"a": "said "no"!"}[2]': ['{"a": "said \\"no\\"!"}', "[2]"]}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", J.json_values("t").alias("v"), J.first_json(F.col("t")).alias("f"))
    got = {r.t: (r.v, r.f) for r in df.collect()}
    assert got == {k: (v, v[0] if v else None) for k, v in cases.items()} | {None: ([], None)}
