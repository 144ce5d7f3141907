import math

import numpy as np
import pytest
from tensors import tensor

from gridloom import engine
from gridloom.model import TensorFrame, TensorMeta, ValidationError
from gridloom.operators import order, reductions
from gridloom.operators import transform as tr


def ask(t, **query):
    from gridloom.plans.document import parse_query_value

    doc = parse_query_value({"dataset": t.meta.name} | query)
    return engine.query(doc, engine.Catalog({t.meta.name: t}))


def values(t, kind, value, **more):
    df = ask(t, **{kind: value}, **more)
    keys = [c for c in df.columns if c != kind]
    return [r[kind] for r in df.orderBy(*keys).collect()] if keys else df.first()[kind]


@pytest.mark.parametrize(
    ("kind", "axes", "expected"),
    [("sum", [], 21), ("mean", [], 3.5), ("min", [], 1), ("max", [], 6), ("count", [], 6), ("var", [], 2.9166667), ("std", [], 1.7078251), ("product", [], 720), ("norm_l1", [], 21), ("norm_l2", [], math.sqrt(91)), ("median", [], 3.5), ("arg_min", [], 0), ("arg_max", [], 5),
     ("var", 0, [2.25] * 3), ("product", 0, [4, 10, 18]), ("sum", 0, [5, 7, 9]), ("min", 0, [1, 2, 3]), ("arg_max", 0, [1, 1, 1]), ("median", 0, [2.5, 3.5, 4.5]), ("sum", 1, [6, 15]), ("count", {"axis": 1}, [3, 3]), ("mean", {"axes": [1]}, [2, 5])],
)
def test_core(a, kind, axes, expected):
    assert values(a, kind, axes) == pytest.approx(expected, rel=1e-6)


def test_quantile_and_histogram(a):
    assert ask(a, quantile={"q": 0.95}).first()[0] == pytest.approx(5.75)
    rows = ask(a, histogram={"bins": 3}).orderBy("bin").collect()
    assert sum(r["n"] for r in rows) == 6 and len(rows) == 3
    rows = ask(a, histogram={"bins": 2, "min": 0, "max": 10}).orderBy("bin").collect()
    assert (rows[0]["lo"], rows[1]["hi"], [r["n"] for r in rows]) == (0, 10, [4, 2])
    # values outside of a given range count in the end bins; empty bins are there
    rows = ask(a, histogram={"bins": 4, "min": 2, "max": 3}).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [2, 0, 0, 4]
    rows = ask(a, histogram={"bins": 2, "axis": 0}).orderBy("c1", "bin").collect()
    assert [r["n"] for r in rows] == [1, 1] * 3


def test_histogram_of_equal_values(spark):
    rows = ask(tensor(spark, [7, 7, 7]), histogram={"bins": 3}).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [3, 0, 0]


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 0.95, 1.0])
def test_narrowed_quantile_equals_one_pass(spark, monkeypatch, q):
    x = np.concatenate([np.random.default_rng(1).normal(size=700), [5.0] * 100, [1e9, -1e9]])
    t = tensor(spark, x.tolist())
    monkeypatch.setattr(order, "LAST", 3)
    monkeypatch.setattr(order, "INTERVALS", 7)
    assert order.narrowed(t, q, "quantile").first()[0] == pytest.approx(np.quantile(x, q), rel=1e-12)


def test_matrices(spark):
    t = tensor(spark, [[1, 2], [3, 4], [5, 6]])
    assert all(r["value"] == pytest.approx(8 / 3) for r in ask(t, covariance=0).collect())
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 5))
    x[:, 4] = 2.0
    t = tensor(spark, x.tolist())
    got = np.zeros((5, 5))
    for r in ask(t, covariance=0).collect():
        got[r["j"], r["k"]] = r["value"]
    assert np.allclose(got, np.cov(x.T, ddof=0))
    corr = {(r["j"], r["k"]): r["value"] for r in ask(t, correlation={"axis": 0}).collect()}
    assert corr[4, 4] == 1.0 and corr[0, 4] == 0.0 and corr[1, 2] == pytest.approx(np.corrcoef(x.T)[1, 2] if False else np.corrcoef(x[:, 1], x[:, 2])[0, 1])
    with pytest.raises(Exception, match="finite"):
        ask(tensor(spark, [[1.0, math.nan], [2.0, 3.0]]), covariance=0).collect()
    with pytest.raises(ValidationError):
        ask(tensor(spark, [1.0, 2.0]), covariance=0)


NAN, INF = math.nan, math.inf


def test_qc(spark):
    t = tensor(spark, [[NAN, 2, 3], [INF, 99, -INF]], attrs={"_FillValue": "99"})
    assert values(t, "nan_count", []) == 1 and values(t, "inf_count", []) == 2 and values(t, "null_count", []) == 1
    assert values(t, "nan_count", 1) == [1, 0] and values(t, "inf_count", 1) == [0, 2] and values(t, "null_count", 0) == [0, 1, 0]
    assert values(t, "any_nan", 1) == [True, False] and values(t, "any_inf", 1) == [False, True] and values(t, "all_finite", 0) == [False, True, False]
    assert values(t, "nan_mean", 1)[0] == 2.5 and values(t, "nan_std", 1)[0] == 0.5
    # NaN is left out of extremes; indices are those of the least place
    assert values(t, "min", 1) == [2, -INF] and values(t, "arg_min", 1) == [1, 2] and values(t, "arg_max", []) == 3
    assert math.isnan(values(tensor(spark, [NAN, NAN]), "min", [])) and values(tensor(spark, [NAN, NAN]), "arg_min", []) is None
    assert values(t, "median", 1)[0] == 2.5
    assert values(t, "null_count", {"fill": 2}) == 1 and values(t, "null_count", {"fill": "nan"}) == 1
    with pytest.raises(ValidationError):
        values(tensor(spark, [1.0]), "null_count", [])


def test_signed_zero_fill(spark):
    t = tensor(spark, [0.0, -0.0, 0.0])
    assert values(t, "null_count", {"fill": 0.0}) == 2 and values(t, "null_count", {"fill": -0.0}) == 1


def test_ties_go_to_the_least_index(spark):
    t = tensor(spark, [[5, 1, 5], [1, 5, 1]], chunk=(1, 2))
    assert values(t, "arg_min", []) == 1 and values(t, "arg_max", []) == 0 and values(t, "arg_max", 1) == [0, 1]


@pytest.mark.parametrize("dtype", ["f32", "f64", "i32", "i64", "u8", "u16", "i16", "u32", "f16", "u64"])
def test_every_type(spark, dtype):
    t = tensor(spark, [[1, 2, 3], [4, 5, 6]], dtype=dtype)
    assert values(t, "sum", []) == 21 and values(t, "median", 0) == [2.5, 3.5, 4.5] and values(t, "nan_mean", []) == 3.5
    assert engine.to_numpy(t).tolist() == [[1, 2, 3], [4, 5, 6]]


def test_large_unsigned(spark):
    t = tensor(spark, [2**64 - 1, 0], dtype="u64")
    assert values(t, "max", []) == float(2**64 - 1)


def test_selection(spark):
    t = tensor(spark, np.arange(1, 13).reshape(4, 3).tolist(), name="s", chunk=(2, 3))
    assert values(t, "sum", [], selection=[{"start": 1, "stop": 3}, {}]) == sum(range(4, 10))
    assert values(t, "sum", 1, selection=[{"start": 1, "stop": 4, "step": 2}, {}]) == [15, 33]
    # indices are those of the selection
    assert values(t, "arg_max", 0, selection=[{"start": 2}, {"step": 2}]) == [1, 1]
    assert [r["v"] for r in ask(t, selection=[{"stop": 2}, {"stop": 2}]).orderBy("c0", "c1").collect()] == [1, 2, 4, 5]
    for bad in ([{"start": 4}, {}], [{"start": 2, "stop": 2}, {}], [{"stop": 5}, {}], [{}]):
        with pytest.raises(ValidationError):
            ask(t, selection=bad)


def test_labels_and_names(spark):
    t = tensor(spark, [[1, 2, 3], [4, 5, 6]], dim_names=("row", "col"), coords={"row": ["r0", "r1"]})
    assert values(t, "mean", [], selection=[{"start_label": "r0", "stop_label": "r1"}, {}]) == 2.0
    assert values(t, "sum", "row") == [5, 7, 9] and values(t, "sum", ["col"]) == [6, 15]
    for bad in ("depth", ["row", 0], 2, [0, 1]):
        with pytest.raises(ValidationError):
            values(t, "sum", bad)
    with pytest.raises(ValidationError):
        values(t, "mean", [], selection=[{"start_label": "r9"}, {}])
    with pytest.raises(ValidationError):
        values(t, "mean", [], selection=[{"start_label": "r0"}, {}, {}])


def shaped(t):
    return engine.to_numpy(t).tolist()


def test_transforms(spark, a):
    x = np.array([[1.0, 2, 3], [4, 5, 6]])
    e = np.exp(x - 6)
    expected = {"center": x - 3.5, "zscore": (x - 3.5) / x.std(), "scale": x / x.std(), "minmax": (x - 1) / 5, "l1": x / 21, "l2": x / math.sqrt(91), "log1p": np.log1p(x - 1), "sqrt": np.sqrt(x - 1), "softmax": e / e.sum()}
    for method, want in expected.items():
        assert np.allclose(shaped(tr.transform(a, method)), want), method
    assert np.allclose(shaped(tr.transform(a, "zscore", (0,))), [[-1] * 3, [1] * 3])
    s = np.exp(x - x.max(1, keepdims=True))
    assert np.allclose(shaped(tr.transform(a, "softmax", (1,))), s / s.sum(1, keepdims=True))
    assert np.allclose(engine.materialize_query('{"dataset": "a", "transform": {"method": "minmax"}}', engine.Catalog({"a": a}))[1, 0], 0.6)


def test_transform_edges(spark):
    flat = tensor(spark, [[2.0, 2.0], [1.0, 3.0]])
    out = shaped(tr.transform(flat, "zscore", (1,)))
    assert np.isnan(out[0]).all() and out[1] == [-1, 1]
    assert tr.warnings(flat, "zscore", (1,)) == (2, [0, 1])
    holes = tensor(spark, [[NAN, 1.0, INF], [NAN, NAN, NAN]])
    soft = shaped(tr.transform(holes, "softmax", (1,)))
    assert math.isnan(soft[0][0]) and soft[0][1] == 1.0 and soft[0][2] == INF and np.isnan(soft[1]).all()
    assert tr.warnings(holes, "zscore") == (1, [1])  # NaN makes the mean NaN
    with pytest.raises(ValidationError):
        tr.transform(tensor(spark, [1, 2], dtype="i32"), "center").df.collect()


def test_meta_rules():
    for bad in (dict(dtype="f8"), dict(shape=()), dict(shape=(0,)), dict(shape=(1,) * 9), dict(chunk_shape=(0,)), dict(dim_names=("a", "b"))):
        with pytest.raises(ValidationError):
            TensorMeta(**(dict(name="x", dtype="f32", shape=(3,)) | bad))


def test_density_is_checked(spark, a):
    a.check()
    with pytest.raises(ValidationError):
        TensorFrame(a.meta, a.df.where("c0 = 0")).check()
    with pytest.raises(ValidationError):
        TensorFrame(a.meta, a.df.unionByName(a.df.limit(1))).check()


def test_one_aggregate_without_python(spark, a):
    plan = reductions.fold_many(a, ["sum", "var", "min", "arg_max"], (0,))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan
