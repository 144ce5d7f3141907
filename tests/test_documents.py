import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.model import TensorMeta, ValidationError
from gridloom.plans.document import AxisSlice, parse_query_json, parse_query_text, parse_query_toml, parse_query_value
from gridloom.plans.geometry import DENSE, STRIDED, read_plan, resolve_selection, touched

PAIRS = [
    ('{"dataset": "temperature", "mean": []}', 'dataset = "temperature"\nmean = []'),
    ('{"dataset": "temperature", "layout_version": 1, "selection": [{"start": 0, "stop": 100, "step": 2}, {}], "mean": []}', 'dataset = "temperature"\nlayout_version = 1\nselection = [{start = 0, stop = 100, step = 2}, {}]\nmean = []'),
    ('{"dataset": "temperature"}', 'dataset = "temperature"'),
    ('{"dataset": "a", "sum": 0}', 'dataset = "a"\nsum = 0'),
    ('{"dataset": "a", "quantile": {"q": 0.5, "axis": 0}}', 'dataset = "a"\nquantile = {q = 0.5, axis = 0}'),
    ('{"dataset": "a", "transform": {"method": "zscore"}, "write": {"target": "sidecar", "timestamp": false}}', 'dataset = "a"\nwrite = {target = "sidecar", timestamp = false}\n[transform]\nmethod = "zscore"'),
]


@pytest.mark.parametrize(("as_json", "as_toml"), PAIRS)
def test_json_and_toml_agree(as_json, as_toml):
    doc = parse_query_json(as_json)
    assert doc == parse_query_toml(as_toml) == parse_query_text(as_json) == parse_query_text(as_toml) == parse_query_text(as_toml, "x.toml")
    assert parse_query_json(doc.to_json()) == doc


@pytest.mark.parametrize(
    "query",
    [{"mean": "time"}, {"mean": ["time", "lat"]}, {"null_count": {"fill": math.nan, "axis": 1}}, {"histogram": {"bins": 3, "min": 0, "max": 1, "axis": [0, 1]}}, {"execution": {"memory_budget_percent": 25, "device": "cuda:1", "fold_parallel": False}}, {"spill": "out.bin"}, {"selection": [{"start_label": "a", "stop_label": "b", "step": 2}]}],
)
def test_round_trip(query):
    value = {"dataset": "d"} | query
    if "null_count" in query:
        value["null_count"]["fill"] = "nan"
    doc = parse_query_value(value)
    again = parse_query_json(doc.to_json())
    assert again.to_wire() == doc.to_wire()


BAD = [
    {}, {"dataset": ""}, {"dataset": 3}, {"dataset": "x" * 1025}, {"dataset": "d", "operation": {}}, {"dataset": "d", "output": {}}, {"dataset": "d", "maen": 0}, {"dataset": "d", "mean": 0, "sum": 0}, {"dataset": "d", "mean": None}, {"dataset": "d", "mean": True}, {"dataset": "d", "mean": -1}, {"dataset": "d", "mean": "9a"},
    {"dataset": "d", "mean": "x" * 33}, {"dataset": "d", "mean": list(range(9))}, {"dataset": "d", "quantile": {"q": 2}}, {"dataset": "d", "quantile": 0}, {"dataset": "d", "histogram": {"bins": 0}}, {"dataset": "d", "histogram": {"bins": 4097}}, {"dataset": "d", "histogram": {"bins": 3, "min": 1}}, {"dataset": "d", "histogram": {"bins": 3, "min": 1, "max": 1}},
    {"dataset": "d", "covariance": []}, {"dataset": "d", "covariance": [0, 1]}, {"dataset": "d", "transform": {"method": "cube"}}, {"dataset": "d", "write": "ram"}, {"dataset": "d", "transform": {"method": "l1"}, "write": "disk"}, {"dataset": "d", "transform": {"method": "l1"}, "write": "spill", "spill": "x"}, {"dataset": "d", "transform": {"method": "l1"}, "write": {"target": "ram", "path": "x"}},
    {"dataset": "d", "transform": {"method": "l1"}, "write": {"target": "spill", "timestamp": True}}, {"dataset": "d", "selection": [{}] * 9}, {"dataset": "d", "selection": [{"step": 0}]}, {"dataset": "d", "selection": [{"begin": 0}]}, {"dataset": "d", "selection": [{"start": 1, "start_label": "x"}]}, {"dataset": "d", "spill": ""}, {"dataset": "d", "execution": {"device": "tpu"}},
    {"dataset": "d", "execution": {"memory_budget_percent": 1, "memory_budget_percent_bps": 100}}, {"dataset": "d", "execution": {"memory_budget_percent": 101}}, {"dataset": "d", "layout_version": -1}, [], "d",
]


@pytest.mark.parametrize("value", BAD, ids=lambda v: json.dumps(v)[:50])
def test_bad_documents(value):
    with pytest.raises(ValidationError):
        parse_query_value(value)


def test_limits():
    with pytest.raises(ValidationError):
        parse_query_json('{"dataset": "d", "mean": ' + "[" * 70 + "]" * 70 + "}")
    with pytest.raises(ValidationError):
        parse_query_json(" " * (1 << 20) + "{}")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_any_text_parses_or_is_refused(text):
    for parse in (parse_query_json, parse_query_toml, parse_query_text):
        try:
            parse(text)
        except ValidationError:
            pass


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.floats() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["dataset", "mean", "q", "axis", "quantile", "selection", "start", "write", "bins", "histogram"]), x, max_size=4), max_leaves=12))
def test_any_tree_parses_or_is_refused(value):
    try:
        parse_query_value(value)
    except ValidationError:
        pass


def test_read_plans():
    m = TensorMeta("s", "f32", (4, 3), (2, 3))
    dense = read_plan(m, resolve_selection(m, [AxisSlice(1, 3), AxisSlice()]))
    strided = read_plan(m, resolve_selection(m, [AxisSlice(1, 3, 2), AxisSlice()]))
    assert (len(dense.chunks), dense.policy, len(strided.chunks), strided.policy) == (2, DENSE, 1, STRIDED)
    assert strided.box.shape == (1, 3) and dense.bytes_logical == 24


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60), st.integers(1, 20), st.integers(0, 59), st.integers(1, 60), st.integers(1, 25))
def test_touched_chunks(n, chunk, start, length, step):
    start = min(start, n - 1)
    stop = min(n, start + length)
    assert touched(n, chunk, start, stop, step) == sorted({i // chunk for i in range(start, stop, step)})
