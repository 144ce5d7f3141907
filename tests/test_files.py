import json
import os

import numpy as np
import pytest
from tensors import tensor

from gridloom import __main__ as cli
from gridloom import engine
from gridloom.model import ValidationError
from gridloom.sources import cf, container, convert, parquet_tensor, zarr3
from gridloom.tools import history, info, output, verify


@pytest.fixture(autouse=True)
def own_cache(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CACHE_HOME", str(tmp_path / "cache"))
    monkeypatch.delenv("GRIDLOOM_HISTORY_FILE", raising=False)


def made(spark, tmp_path, codec=container.RAW, **more):
    path = str(tmp_path / "t.bin")
    t = tensor(spark, [[1, 2, 3], [4, 5, 6]], chunk=(2, 2), dim_names=("row", "col"), coords={"row": ["r0", "r1"]}, attrs={"units": "K"}, **more)
    container.write_container(path, [t], codec, history=[container.Event("convert", "test")])
    return path


@pytest.mark.parametrize("codec", [container.RAW, container.ZSTD])
@pytest.mark.parametrize("dtype", ["f32", "f64", "i32", "i64", "u8", "u16", "i16", "u32", "f16", "u64"])
def test_container_round_trip(spark, tmp_path, dtype, codec):
    path = made(spark, tmp_path, codec, dtype=dtype)
    s = container.read_summary(path)
    m = s.datasets[0]
    assert (m.dtype, m.shape, m.chunk_shape, m.dim_names, m.labels(0), m.attrs) == (dtype, (2, 3), (2, 2), ("row", "col"), ["r0", "r1"], {"units": "K"})
    assert [c.index for c in s.chunks] == [(0, 0), (0, 1)] and s.history[0].op == "convert"
    t = container.open_tensor(spark, path, "a")
    assert engine.to_numpy(t).tolist() == [[1, 2, 3], [4, 5, 6]]
    r = verify.verify(path, deep=True, spark=spark)
    assert r.ok and [f.check for f in r.findings] == list(verify.CHECKS)


def test_selection_reads_touched_tiles_only(spark, tmp_path):
    path = str(tmp_path / "v.bin")
    t = tensor(spark, np.arange(34 * 64).reshape(34, 64).tolist(), name="big", dtype="f32", chunk=(4, 4))
    container.write_container(path, [t])
    s = container.read_summary(path)
    assert len(s.chunks) == 144 and verify.verify(path).summary["chunks_decoded"] == 128 and verify.verify(path, deep=True, spark=spark).summary["chunks_decoded"] == 144
    with open(path, "r+b") as f:  # spoil a tile that the query doesn't touch
        f.seek(s.chunks[100].offset)
        f.write(b"\xff" * 64)
    c = container.open_catalog(spark, path)
    doc = '{"dataset": "big", "selection": [{"stop": 8}, {"start": 4, "stop": 12, "step": 3}], "sum": []}'
    assert engine.query(doc, c).first()[0] == np.arange(34 * 64).reshape(34, 64)[:8, 4:12:3].sum()
    assert len(engine.plan_read_for_document(engine.parse(doc), c).chunks) == 4


def test_append_and_session(spark, tmp_path):
    path = made(spark, tmp_path, container.ZSTD)
    old = container.read_summary(path)
    raw = [container.read_range(path, c.offset, c.stored) for c in old.chunks]
    s = container.Session(path, append=True).add(tensor(spark, [7, 8]), name="b").note("derive", "a", parents=["a"])
    s.commit()
    new = container.read_summary(path)
    assert [d.name for d in new.datasets] == ["a", "b"] and [e.op for e in new.history] == ["convert", "derive"]
    assert [container.read_range(path, c.offset, c.stored) for c in new.chunks[:2]] == raw and verify.verify(path, deep=True).ok
    with pytest.raises(ValidationError):
        s.commit()
    with pytest.raises(ValidationError):
        container.append(path, [tensor(spark, [1], name="b")])
    with pytest.raises(ValidationError):
        container.write_container(path, [tensor(spark, list(range(70)), coords={"0": [str(i) for i in range(70)]})])
    assert [d.name for d in container.read_summary(path).datasets] == ["a", "b"]


def test_long_metadata_is_spilled(spark, tmp_path):
    path = str(tmp_path / "m.bin")
    attrs = {f"k{i}": "x" * 1000 for i in range(64)}
    container.write_container(path, [tensor(spark, [1], name=f"d{i}", attrs=attrs) for i in range(2)])
    assert all(dict(d.attrs) == attrs for d in container.read_summary(path).datasets) and verify.verify(path).ok


def test_empty_file(tmp_path):
    path = str(tmp_path / "e.bin")
    container.write_empty(path)
    assert os.path.getsize(path) == 32 and container.read_summary(path).datasets == [] and verify.verify(path).ok


@pytest.mark.parametrize(
    ("at", "change", "check"),
    [(0, b"X", "superblock"), (4, b"\x09", "superblock"), (44, b"\x63", "dataset_directory"), (48, b"\x00", "dataset_directory"), (16, b"\xff", None)],
)
def test_damage_is_found(spark, tmp_path, at, change, check):
    path = made(spark, tmp_path)
    with open(path, "r+b") as f:
        f.seek(at)
        f.write(change)
    r = verify.verify(path)
    assert not r.ok and r.recommendations and (check is None or [f.check for f in r.findings if f.severity == "error"] == [check])
    with pytest.raises(container.ContainerError):
        container.read_summary(path)


def test_damage_of_entries(spark, tmp_path):
    for field, value, check in ((72, 1 << 40, "chunk_payloads"), (0, 9, "chunk_dataset_ids"), (80, 8, "dataset_tensor_bytes")):
        path = made(spark, tmp_path)
        s = container.read_summary(path)
        with open(path, "r+b") as f:
            f.seek(s.index[0] + 32 + field)
            f.write(value.to_bytes(8, "little"))
        r = verify.verify(path)
        assert not r.ok and check in [f.check for f in r.findings if f.severity == "error"]
    for n in (10, 35, 100):
        path = made(spark, tmp_path)
        with open(path, "r+b") as f:
            f.truncate(n)
        assert not verify.verify(path).ok


def test_repair_of_a_footer(spark, tmp_path):
    path = made(spark, tmp_path)
    s = container.read_summary(path)
    with open(path, "r+b") as f:
        f.seek(s.footer_start)
        f.write(b"X" * 8)
    r = verify.verify(path)
    assert not r.ok and [x["code"] for x in r.recommendations] == ["footer_invalid"]
    assert verify.repair(path, ["footer_invalid"], dry_run=True)["applied"] == [] and not verify.verify(path).ok
    assert verify.repair(path, ["footer_invalid"])["ok"] and verify.verify(path).ok
    assert engine.to_numpy(container.open_tensor(spark, path, "a")).tolist() == [[1, 2, 3], [4, 5, 6]]
    with pytest.raises(container.ContainerError):
        verify.repair(path, ["footer_invalid"])


@pytest.mark.parametrize("codec", [container.RAW, container.ZSTD])
def test_zarr_round_trip(spark, tmp_path, codec):
    path = str(tmp_path / "g.bin")
    container.write_container(path, [tensor(spark, np.arange(35).reshape(5, 7).tolist(), name="primary/x", dtype="i32", chunk=(2, 3)), tensor(spark, [1.5, 2.5], name="y", dim_names=("t",))], codec)
    out = str(tmp_path / "g.zarr")
    assert zarr3.export(spark, path, out) == 9 + 1
    assert convert.sniff(out) == "zarr" and sorted(n for n, _ in zarr3.arrays(out)) == ["primary/x", "y"]
    c = zarr3.open_catalog(spark, out)
    assert engine.to_numpy(c.get("primary/x")).tolist() == np.arange(35).reshape(5, 7).tolist() and c.get("y").meta.dim_names == ("t",)
    assert engine.query('{"dataset": "primary/x", "selection": [{"start": 4}, {"start": 6}], "max": []}', c).first()[0] == 34
    os.unlink(f"{out}/primary/x/c/0/0")  # a missing chunk has the fill value
    assert engine.to_numpy(zarr3.open_catalog(spark, out).get("primary/x"))[:2, :3].tolist() == [[0] * 3] * 2
    with pytest.raises(ValidationError):
        zarr3.export(spark, path, out)
    back = str(tmp_path / "back.bin")
    assert sorted(convert.convert(spark, out, back)) == ["primary/x", "y"] and verify.verify(back, deep=True).ok


def test_unknown_codec_is_refused(spark, tmp_path):
    node = zarr3.array_json(tensor(spark, [1.0]).meta, False)
    node["codecs"].append({"name": "blosc"})
    with pytest.raises(ValidationError):
        zarr3.open_tensor(spark, str(tmp_path), "x", node)


def test_cf(spark):
    t = cf.decode(tensor(spark, [100.0, -9999.0, 200.0], dtype="f32", attrs={"scale_factor": "0.01", "add_offset": "273.15", "_FillValue": "-9999"}))
    got = engine.to_numpy(t)
    assert np.allclose(got[[0, 2]], [274.15, 275.15]) and np.isnan(got[1])
    assert engine.query('{"dataset": "a", "null_count": []}', engine.Catalog({"a": t})).first()[0] == 1
    plain = tensor(spark, [1.0], attrs={"_FillValue": "1"})
    assert cf.decode(plain) is plain


def test_parquet_store(spark, tmp_path):
    store = str(tmp_path / "store")
    t = tensor(spark, np.arange(60).reshape(12, 5).tolist(), name="g/x", dtype="i64", chunk=(3, 5), dim_names=("t", "x"), attrs={"units": "m"})
    parquet_tensor.write(t, store)
    assert parquet_tensor.names(spark, store) == ["g/x"]
    back = parquet_tensor.read(spark, store, "g/x")
    assert back.meta == t.meta and engine.to_numpy(back).tolist() == np.arange(60).reshape(12, 5).tolist()
    c = engine.Catalog({"g/x": back})
    df = engine.query('{"dataset": "g/x", "selection": [{"start": 6, "stop": 9}, {}], "sum": []}', c)
    assert df.first()[0] == np.arange(30, 45).sum()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(k0" in plan and "PushedFilters: [IsNotNull(c0)" in plan
    with pytest.raises(ValidationError):
        parquet_tensor.write(t, store)
    with pytest.raises(ValidationError):
        parquet_tensor.read(spark, store, "no")


def test_sniff(tmp_path):
    for name, kind in (("a.H5", "hdf5"), ("b.nc.gz", "netcdf"), ("c.cdf", "netcdf")):
        assert convert.sniff(str(tmp_path / name)) == kind
    p = tmp_path / "blob"
    p.write_bytes(b"\x89HDF\r\n\x1a\n...")
    assert convert.sniff(str(p)) == "hdf5"
    p.write_bytes(b"nothing here")
    with pytest.raises(ValidationError):
        convert.sniff(str(p))
    with pytest.raises(ValidationError):
        convert.sniff(str(tmp_path))


def test_responses(spark, tmp_path):
    path = made(spark, tmp_path)
    c = container.open_catalog(spark, path)
    echo = engine.execute_query_json('{"dataset": "a", "mean": []}')
    assert echo["status"] == "planned" and echo["accepted"] and echo["read_plan"] is None
    r = engine.execute_query_json('{"dataset": "nope"}', c)
    assert r["catalog"] == {"matched": False, "available_datasets": ["a"]} and "a" in output.miss_hint(r)
    r = engine.execute_query_json('{"dataset": "a", "sum": "row"}', c, preview_limit=2)
    e = r["execution"]
    assert e["operation_reduced_shape"] == [3] and e["operation_reduced_sum"] == [5, 7, 9] and e["f64_preview"] == [1, 2] and e["f64_preview_truncated"]
    assert r["catalog"]["dataset_f64_bytes"] == 48 and r["read_plan"]["chunk_count"] == 2
    e = engine.execute_query_json('{"dataset": "a", "arg_max": [], "execution": {"device": "cuda:0"}}', c, preview_limit=0)["execution"]
    assert e["operation_argmax_index"] == 5 and e["device_fallback_reason"] == "gpu_feature_disabled" and e["device_used"] == "cpu"
    e = engine.execute_query_json('{"dataset": "a", "histogram": {"bins": 2, "min": 0, "max": 10}}', c, preview_limit=0)["execution"]
    assert e["operation_histogram_edges"] == [0, 5, 10] and e["operation_histogram_counts"] == [4, 2]
    e = engine.execute_query_json('{"dataset": "a", "covariance": 1}', c, preview_limit=0)["execution"]
    assert e["operation_covariance_order"] == 2 and len(e["operation_covariance"]) == 4
    for bad in ('{"dataset": "a"}', '{"dataset": "a", "transform": {"method": "l1"}, "write": "ram", "execution": {"memory_budget_bytes": 1}}'):
        with pytest.raises(ValidationError):
            engine.execute_query_json(bad, c, preview_limit=0)
    with pytest.raises(ValidationError):
        engine.execute_query_json('{"dataset": "a", "execution": {"memory_budget_bytes": 1}}', c, preview_limit=5)
    for form in output.FORMATS:
        assert output.render(r, form)


def test_spill_and_sidecar(spark, tmp_path):
    path = made(spark, tmp_path)
    c = container.open_catalog(spark, path)
    e = engine.execute_query_json('{"dataset": "a", "selection": [{}, {"start": 1}], "spill": "out.bin"}', c, preview_limit=0)["execution"]
    assert np.fromfile(e["spill_path"], "<f8").tolist() == [2, 3, 5, 6] and e["spill_path"] == str(tmp_path / "out.bin")
    with pytest.raises(ValidationError):
        engine.execute_query_json('{"dataset": "a", "spill": "/etc/out.bin"}', c, preview_limit=0)
    with pytest.raises(ValidationError):
        engine.execute_query_json('{"dataset": "a", "spill": "../out.bin"}', c, preview_limit=0)
    e = engine.execute_query_json('{"dataset": "a", "transform": {"method": "minmax"}, "execution": {"memory_budget_bytes": 1}}', c, preview_limit=0)["execution"]
    assert np.allclose(np.fromfile(e["spill_path"]), np.arange(6) / 5)
    e = engine.execute_query_json('{"dataset": "a", "selection": [{"start": 1}, {}], "transform": {"method": "center"}, "write": {"target": "sidecar", "timestamp": false}}', c, preview_limit=0)["execution"]
    assert e["sidecar_path"] == str(tmp_path / f"t.center{container.EXTENSION}")
    s = container.read_summary(e["sidecar_path"])
    assert s.datasets[0].name == "a-center" and s.datasets[0].attrs["derived_from"] == "a" and s.datasets[0].labels(0) == ["r1"] and s.history[0].op == "transform"
    assert engine.to_numpy(container.open_tensor(spark, e["sidecar_path"], "a-center")).tolist() == [[-1, 0, 1]]


def test_command_line(spark, tmp_path, capsys):
    path = made(spark, tmp_path)

    def run(*args):
        code = cli.main(list(args))
        got = capsys.readouterr()
        return code, got.out, got.err

    assert run("info", path)[1].startswith("a  f64  shape [2, 3]") and "datasets=1 chunks=2" in run("info", path, "-q")[1]
    assert json.loads(run("info", path, "--json")[1])["datasets"][0]["name"] == "a" and "convert" in run("info", path, "--all")[1]
    assert run("verify", path, "-q") == (0, "status=ok\n", "")
    assert run("query", '{"dataset": "a", "mean": []}', "-t", path, "-x", "-q")[1].strip() == "status=planned dataset=a element_count=6 mean=3.5"
    assert "datasets: a" in run("query", '{"dataset": "b"}', "-t", path)[2]
    assert run("query", "dataset = 3")[0] == 1 and run("info", str(tmp_path / "none"))[0] == 1
    assert '"mean": []' in run("history", "list")[1] and "mean=3.5" in run("history", "run", "2", "-q")[1]
    assert run("history", "--clear")[0] == 0 and history.load() == []
    assert run("export", path, str(tmp_path / "o.zarr"))[0] == 0 and run("convert", str(tmp_path / "o.zarr"), str(tmp_path / "o.bin"))[0] == 0
    assert run("repair", path)[1].startswith("planned: nothing")
    with open(path, "r+b") as f:
        f.write(b"X")
    assert run("verify", path, "-q")[0] == 1


def test_history(monkeypatch):
    monkeypatch.setenv("GRIDLOOM_HISTORY_MAX", "3")
    docs = [engine.parse('{"dataset": "d%d"}' % i) for i in (1, 1, 2, 3, 4)]
    for d in docs:
        history.record(d, "f", "plan")
    assert [r["query"]["dataset"] for r in history.listed()] == ["d4", "d3", "d2"] and history.pick(1)["query"] == {"dataset": "d4"}
    history.record(docs[-1], "f", "plan")
    assert history.load()[-1]["count"] == 2 and history.listed(dataset="d3")[0]["query"]["dataset"] == "d3"
    with pytest.raises(IndexError):
        history.pick(9)


def test_info_frames(spark, tmp_path):
    s = container.read_summary(made(spark, tmp_path))
    assert info.chunks_frame(spark, s).count() == 2 and info.datasets_frame(spark, s).first()["dtype"] == "f64" and info.history_frame(spark, s).first()["op"] == "convert"


def test_public_names():
    import gridloom

    assert all(callable(getattr(gridloom, name)) or name == "DTYPES" for name in gridloom.__all__) and "verify" in gridloom.__all__
    with pytest.raises(AttributeError):
        gridloom.nothing


def test_endings_and_attributes_of_imports():
    from gridloom.sources import convert

    assert convert.sniff("a/b.ncdf") == convert.sniff("b.nc.gz") == "netcdf"
    assert list(convert._attrs({"other": 1, "title": "t", "units": "K", "description": b"d"})) == ["units", "description", "title", "other"]


def test_advice_to_decode_every_chunk():
    from gridloom.tools.verify import Report

    r = Report("x", 1, summary={"chunks": 200, "chunks_decoded": 128})
    assert [x["code"] for x in r.recommendations] == ["run_deep_verify"]
    assert Report("x", 1, summary={"chunks": 5, "chunks_decoded": 5}).recommendations == []


def test_stats_are_json():
    import json

    from gridloom.tools.output import render

    response = {"status": "planned", "message": "query executed", "dataset": "a", "operation": {"mean": []}, "execution": {"operation_mean": 2.5, "memory_strategy": "streaming_fold"}}
    got = json.loads(render(response, "stats"))
    assert got["operation"] == "mean" and got["values"] == {"mean": 2.5} and got["execution"] == {"memory_strategy": "streaming_fold"}
    assert render(response, "quiet") == "status=planned dataset=a mean=2.5"
