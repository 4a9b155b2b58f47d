"""Pictures: placeholders (blurhash) of pixels, and a stand-in for an image encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

# fixed values: the digits of the format, and the default numbers of components
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz#$%*+,-.:;=?@[]^_{|}~"
ACROSS, DOWN = 4, 3


def _digits(value: int, length: int) -> str:
    return "".join(DIGITS[value // 83 ** (length - 1 - i) % 83] for i in range(length))


def _linear(x: np.ndarray) -> np.ndarray:
    v = x / 255.0
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def _srgb(x: np.ndarray) -> np.ndarray:
    v = np.clip(x, 0, 1)
    return (np.where(v <= 0.0031308, v * 12.92, 1.055 * v ** (1 / 2.4) - 0.055) * 255 + 0.5).astype(int)


def blurhash(pixels: np.ndarray, across: int = ACROSS, down: int = DOWN) -> str:
    """Placeholder of an image of (height, width, 3) bytes: a few cosine components in 83 digits."""
    if not (1 <= across <= 9 and 1 <= down <= 9):
        raise ValueError("from 1 to 9 components either way")
    h, w, _ = pixels.shape
    x = np.cos(np.pi * np.outer(np.arange(across), np.arange(w)) / w)
    y = np.cos(np.pi * np.outer(np.arange(down), np.arange(h)) / h)
    # one product of matrices gives all components of all channels
    parts = np.einsum("jy,yxc,ix->jic", y, _linear(pixels.astype(float)), x) / (w * h)
    parts = parts.reshape(-1, 3) * np.r_[1.0, np.full(across * down - 1, 2.0)][:, None]
    out = _digits(across - 1 + (down - 1) * 9, 1)
    ac = parts[1:]
    if len(ac):
        scale = int(np.clip(np.floor(np.abs(ac).max() * 166 - 0.5), 0, 82))
        largest = (scale + 1) / 166
    else:
        scale, largest = 0, 1.0
    r, g, b = _srgb(parts[0])
    out += _digits(scale, 1) + _digits((int(r) << 16) + (int(g) << 8) + int(b), 4)
    steps = np.clip(np.floor(np.sign(ac) * np.sqrt(np.abs(ac) / largest) * 9 + 9.5), 0, 18).astype(int)
    return out + "".join(_digits(int(p @ (361, 19, 1)), 2) for p in steps)


def blurhash_of(pixels: Column, width: int, height: int) -> Column:
    """Placeholder of RGB bytes of one size; null for what has another length."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            out = []
            for raw in part.to_pylist():
                fits = raw is not None and len(raw) == 3 * width * height
                out.append(blurhash(np.frombuffer(raw, np.uint8).reshape(height, width, 3)) if fits else None)
            yield pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(pixels)


def mock_image_embedding(content: Column, dim: int) -> Column:
    """A unit vector drawn from a generator that the contents' hash seeds: equal contents, equal vectors; null for null."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            out = []
            for raw in part.to_pylist():
                if raw is None:
                    out.append(None)
                    continue
                v = np.random.default_rng(int.from_bytes(hashlib.sha256(raw).digest()[:8], "big")).standard_normal(dim)
                out.append(v / np.linalg.norm(v))
            yield pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(content)
