"""Centroids in files of saved tensors (``.pt``): a zip of one pickle and its tensors' bytes.

A file is a row of Spark's binary file source, so files are spread over tasks and may lie anywhere that
Spark reads.  A pickle can name any function; here only those that make up plain values and
tensors are known, and a file that names another is not read further but gives its reason.
"""

from __future__ import annotations

import collections
import io
import pickle
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.sources.centroids import SCHEMA

#: Longest file that is opened: a centroid has a few thousand numbers.
MOST_BYTES = 64 << 20
# fixed values: the names of storages in such files, and what their bytes are
DTYPES = {"DoubleStorage": "f8", "FloatStorage": "f4", "HalfStorage": "f2", "BFloat16Storage": "bf16", "LongStorage": "i8", "IntStorage": "i4"}
OUT = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMA) + ", source string, reason string"


def _tensor(storage: np.ndarray, offset: int, size: tuple, stride: tuple, *_) -> np.ndarray:
    """A view of a storage, checked to lie within it."""
    if len(size) != len(stride) or min((offset, *size, *stride), default=0) < 0 or offset + sum((n - 1) * s for n, s in zip(size, stride)) >= max(1, len(storage)):
        raise pickle.UnpicklingError("a tensor is larger than what is stored of it")
    if 0 in size:
        return np.zeros(size)
    index = offset + sum(np.arange(n).reshape([-1 if i == k else 1 for i in range(len(size))]) * s for k, (n, s) in enumerate(zip(size, stride)))
    return storage[index]


class _Reader(pickle.Unpickler):
    def __init__(self, box: zipfile.ZipFile, pickled: str):
        super().__init__(io.BytesIO(box.read(pickled)))
        self.box, self.root = box, pickled[: -len("data.pkl")]
        order = f"{self.root}byteorder"
        self.order = ">" if order in box.namelist() and box.read(order).strip() == b"big" else "<"

    def find_class(self, module: str, name: str):
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return _tensor
        if (module, name) == ("collections", "OrderedDict"):
            return collections.OrderedDict
        if module == "torch" and name in DTYPES:
            return name  # a storage is known by its name alone
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")

    def persistent_load(self, pid):
        kind, dtype, key = pid[:3]
        if kind != "storage" or dtype not in DTYPES.keys():
            raise pickle.UnpicklingError("an unknown kind of storage")
        raw = self.box.read(f"{self.root}data/{key}")
        if DTYPES[dtype] == "bf16":  # the upper half of a float
            return (np.frombuffer(raw, self.order + "u2").astype("u4") << 16).view("f4")
        return np.frombuffer(raw, self.order + DTYPES[dtype])


def load_tensors(content: bytes) -> object:
    """What a file holds, its tensors as numpy arrays; an error if it holds anything but values and tensors."""
    with zipfile.ZipFile(io.BytesIO(content)) as box:
        pickled = [n for n in box.namelist() if n == "data.pkl" or n.endswith("/data.pkl")]
        if len(pickled) != 1:
            raise ValueError("not one pickle in the file")
        if sum(i.file_size for i in box.infolist()) > MOST_BYTES:
            raise ValueError("too large when unpacked")
        return _Reader(box, pickled[0]).load()


def _centroid(content: bytes) -> dict:
    if content is None:
        raise ValueError("too large")
    held = load_tensors(content)
    if not isinstance(held, dict):
        raise ValueError("not a dictionary")
    missing = [k for k in ("centroid", "name", "model", "feature_dim") if held.get(k) is None]
    if missing:
        raise ValueError("without " + ", ".join(missing))
    vector, dim, name = held["centroid"], int(held["feature_dim"]), str(held["name"]).strip()
    if not isinstance(vector, np.ndarray) or vector.shape != (dim,):
        raise ValueError(f"the centroid does not have {dim} dimensions")
    if not name:
        raise ValueError("without a name")
    model = str(held["model"])
    return {
        "name": name,
        "model": model,
        "model_type": str(held.get("model_type", model)),
        "feature_dim": dim,
        "n_images": int(held.get("n_images") or 0),
        "extracted_at": str(held.get("extracted_at") or ""),
        "centroid": vector.astype("f4").astype(float).tolist(),
    }


def read_tensor_centroids(spark: SparkSession, path: str) -> DataFrame:
    """Centroids of the ``.pt`` files of a folder, in single precision, as ``read_centroids`` gives them; ``reason`` says why a file has none.

    ``usable_centroids`` takes its rows, and leaves those of bad files out.  Files without a byte give no row, as Spark skips them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pt").load(path)
    names = [*SCHEMA.names, "source", "reason"]

    def decode(frames):
        for frame in frames:
            out = []
            for source, content in zip(frame["path"], frame["content"]):
                try:
                    row = {**_centroid(content), "reason": None}
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a file is its reason
                    row = {"reason": f"{type(e).__name__}: {e}"}
                out.append([row.get(n) if n != "source" else source for n in names])
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"feature_dim": "Int32", "n_images": "Int64"})

    return files.select("path", F.when(F.col("length") <= MOST_BYTES, F.col("content")).alias("content")).mapInPandas(decode, OUT)
