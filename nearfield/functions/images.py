"""Features of images, computed from the bytes that Spark's image source decodes.

The source gives rows of blue, green, red (and alpha) bytes. Arrays go through
Arrow in batches; numpy does the arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HSV_BINS = (12, 6, 6)
PHASH_SIDE, PHASH_LOW = 32, 8
EMBEDDING_SIDE = 32


def to_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray | None:
    """uint8, height x width x 3; grey is repeated, alpha dropped; None for what isn't an image."""
    if data is None or height <= 0 or width <= 0 or channels not in (1, 3, 4) or len(data) != height * width * channels:
        return None
    a = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


def rgb_to_hsv(rgb: np.ndarray) -> np.ndarray:
    """8-bit hexcone: hue in [0, 180), saturation and value in [0, 255]."""
    x = rgb.astype(np.float64)
    high, low = x.max(axis=-1), x.min(axis=-1)
    spread = high - low
    safe = np.where(spread > 0, spread, 1.0)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    sector = np.select([high == r, high == g], [(g - b) / safe, 2.0 + (b - r) / safe], 4.0 + (r - g) / safe)
    hue = np.where(spread > 0, np.mod(sector * 30.0, 180.0), 0.0)
    hue = np.mod(np.rint(hue), 180)
    saturation = np.where(high > 0, np.rint(255.0 * spread / np.where(high > 0, high, 1.0)), 0.0)
    return np.stack([hue, saturation, high], axis=-1).astype(np.uint8)


def hsv_histogram(rgb: np.ndarray) -> np.ndarray:
    """432 shares of pixels by hue, saturation and value; float32, sum 1."""
    hsv = rgb_to_hsv(rgb).reshape(-1, 3).astype(np.int64)
    nh, ns, nv = HSV_BINS
    at = (hsv[:, 0] * nh // 180 * ns + hsv[:, 1] * ns // 256) * nv + hsv[:, 2] * nv // 256
    counts = np.bincount(at, minlength=nh * ns * nv).astype(np.float32)
    return counts / max(1.0, float(counts.sum()))


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma with the weights of BT.601."""
    return rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, sampling pixel centres."""

    def axis(n: int, m: int):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(image.shape[0], height)
    x0, x1, fx = axis(image.shape[1], width)
    extra = (1,) * (image.ndim - 2)
    fy, fx = fy.reshape(-1, 1, *extra), fx.reshape(1, -1, *extra)
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def dct_matrix(n: int) -> np.ndarray:
    """Orthonormal DCT-II."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.sqrt(2.0 / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))
    m[0] /= np.sqrt(2.0)
    return m


def phash(rgb: np.ndarray) -> np.ndarray:
    """64 zeros and ones: low frequencies above their median."""
    m = dct_matrix(PHASH_SIDE)
    low = (m @ resize(grey(rgb), PHASH_SIDE, PHASH_SIDE) @ m.T)[:PHASH_LOW, :PHASH_LOW].ravel()
    return (low > np.median(low)).astype(np.uint8)


def random_embedding(dim: int = 512, seed: int = 42) -> Callable[[np.ndarray], np.ndarray]:
    """A seeded random projection of the small image: a stand-in for a network, and not the same function."""
    planes = np.random.default_rng(seed).normal(size=(EMBEDDING_SIDE * EMBEDDING_SIDE * 3, dim)) / EMBEDDING_SIDE

    def embed(rgb: np.ndarray) -> np.ndarray:
        x = resize(rgb.astype(np.float64) / 255.0, EMBEDDING_SIDE, EMBEDDING_SIDE).ravel() - 0.5
        return (x @ planes).astype(np.float32)

    return embed


def image_udf(feature: Callable[[np.ndarray], np.ndarray], kind: str = "array<float>"):
    """A column function of an image struct; null for what isn't an image."""

    @F.pandas_udf(kind)
    def run(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for d, h, w, c in zip(data, height, width, channels, strict=True):
            rgb = to_rgb(d, int(h), int(w), int(c)) if d is not None and h == h else None
            out.append(None if rgb is None else feature(rgb).tolist())
        return pd.Series(out)

    return lambda image: run(image["data"], image["height"], image["width"], image["nChannels"])


def extractors(dim: int = 512, seed: int = 42) -> dict[str, Callable[[Column], Column]]:
    """Each feature's function of an image column; the embedding can be replaced by any callable."""
    return {"hsv": image_udf(hsv_histogram), "phash": image_udf(lambda x: phash(x).astype(np.float32)), "embedding": image_udf(random_embedding(dim, seed))}


def thumbnail(rgb: np.ndarray, side: int = 96) -> np.ndarray:
    """At most side x side, nearest pixels, proportions kept."""
    h, w = rgb.shape[:2]
    scale = min(1.0, side / max(h, w))
    hh, ww = max(1, round(h * scale)), max(1, round(w * scale))
    return rgb[(np.arange(hh) * h // hh)][:, (np.arange(ww) * w // ww)]
