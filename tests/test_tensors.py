"""Files of saved tensors, written here without the library that they come from."""

import io
import os
import pickle
import sys
import types
import zipfile

import numpy as np
import pytest

from quern.sources.centroids import usable_centroids
from quern.sources.tensors import load_tensors, read_tensor_centroids

STORAGES = {"f4": "FloatStorage", "f8": "DoubleStorage", "f2": "HalfStorage", "bf16": "BFloat16Storage"}


class Saved:
    """An array to be saved; ``form`` may give other (offset, size, stride) of its storage."""

    def __init__(self, array, dtype, form=None):
        self.array, self.dtype, self.form = np.asarray(array, float), dtype, form


@pytest.fixture
def save(monkeypatch):
    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")

    def _rebuild_tensor_v2():
        pass

    _rebuild_tensor_v2.__module__, _rebuild_tensor_v2.__qualname__ = "torch._utils", "_rebuild_tensor_v2"
    utils._rebuild_tensor_v2 = _rebuild_tensor_v2
    for name in STORAGES.values():
        setattr(torch, name, type(name, (), {"__module__": "torch"}))
    torch._utils = utils
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "torch._utils", utils)

    def write(held, order="<"):
        stored = {}

        class Storage:
            def __init__(self, saved):
                self.saved = saved

        class Writer(pickle.Pickler):
            def persistent_id(self, x):
                if not isinstance(x, Storage):
                    return None
                key, s = str(len(stored)), x.saved
                if s.dtype == "bf16":
                    stored[key] = (s.array.astype("f4").view("u4") >> 16).astype(order + "u2").tobytes()
                else:
                    stored[key] = s.array.astype(order + s.dtype).tobytes()
                return ("storage", getattr(torch, STORAGES[s.dtype]), key, "cpu", s.array.size)

            def reducer_override(self, x):
                if not isinstance(x, Saved):
                    return NotImplemented
                offset, size, stride = x.form or (0, x.array.shape, tuple(s // 8 for s in np.ascontiguousarray(x.array).strides))
                return utils._rebuild_tensor_v2, (Storage(x), offset, size, stride, False, {})

        data, out = io.BytesIO(), io.BytesIO()
        Writer(data, 2).dump(held)
        with zipfile.ZipFile(out, "w") as box:
            box.writestr("archive/data.pkl", data.getvalue())
            box.writestr("archive/byteorder", "big" if order == ">" else "little")
            for key, raw in stored.items():
                box.writestr(f"archive/data/{key}", raw)
        return out.getvalue()

    return write


@pytest.mark.parametrize("dtype", STORAGES)
@pytest.mark.parametrize("order", "<>")
def test_tensors(save, dtype, order):
    values = np.array([[0.5, -1.25, 3], [4, 0, -0.0625]])
    held = load_tensors(save({"a": Saved(values, dtype), "t": Saved(values.ravel(), dtype, (1, (3, 2), (1, 2))), "n": 3, "e": Saved([], dtype)}, order))
    assert held["n"] == 3 and (held["a"] == values).all() and held["e"].shape == (0,)
    assert (held["t"] == [[-1.25, 4], [3, 0], [4, -0.0625]]).all()
    with pytest.raises(pickle.UnpicklingError):
        load_tensors(save({"a": Saved(values, dtype, (4, (3,), (1,)))}, order))


def test_files_of_a_folder(save, spark, tmp_path):
    class Hostile:
        def __reduce__(self):
            return os.mkdir, (str(tmp_path / "broken-in"),)

    good = {"centroid": Saved([0.1, 0.2, 0.3], "f4"), "name": " sea ", "model": "m", "feature_dim": 3, "n_images": 7, "extracted_at": "2024"}
    files = {
        "a": save(good),
        "b": save({**good, "centroid": Saved([1, 2, 3], "f2"), "name": "hill"}),
        "c": save({**good, "name": "sea", "n_images": 9}),  # the first of a name counts
        "d": save({**good, "model": "other", "name": "town"}),
        "e": save({**good, "feature_dim": 4}),
        "f": save({k: v for k, v in good.items() if k != "name"}),
        "g": save([1, 2]),
        "h": save({**good, "x": Hostile()}),
        "i": b"no zip",
        "j": b"",
    }
    for name, content in files.items():
        (tmp_path / f"{name}.pt").write_bytes(content)
    (tmp_path / "k.txt").write_bytes(files["a"])
    raw = read_tensor_centroids(spark, str(tmp_path))
    reasons = {r.source[-4]: r.reason for r in raw.collect()}
    assert sorted(reasons) == sorted(set(files) - {"j"}) and {k for k, r in reasons.items() if r is None} == set("abcd")
    assert "not allowed" in reasons["h"] and "mkdir" in reasons["h"] and not (tmp_path / "broken-in").exists()
    assert "name" in reasons["f"] and "dictionary" in reasons["g"] and "dimensions" in reasons["e"]
    got = {r.name: r for r in usable_centroids(raw, "m", 3).collect()}
    assert set(got) == {"sea", "hill"} and got["sea"].n_images == 7 and got["sea"].model_type == "m"
    assert got["sea"].centroid == np.float32([0.1, 0.2, 0.3]).astype(float).tolist() and got["hill"].centroid == [1.0, 2.0, 3.0]
