"""Vectorised words, word hashes and shingles over whole batches of texts.

A word is a maximal run of bytes other than space and 0x09-0x0D. Texts are
UTF-8 bytes throughout, so nothing is decoded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (in place on a copy)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    tables = worker_cache()
    if len(tables.get("pow", ())) < n:
        size = max(n, _BLOCK + 4096)
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, dtype=U64)
            table[0] = 1
            tables[name] = np.cumprod(table, dtype=U64)
    return tables["pow"], tables["inv"]


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word buf[start:end]."""
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, side="right")))
        size = int(ends[j - 1]) - base
        power, inverse = _powers(size + 1)
        total = np.zeros(size + 1, dtype=U64)
        np.cumsum((buf[base : base + size].astype(U64) + U64(1)) * power[:size], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[e] - total[s]) * inverse[s] ^ ((e - s).astype(U64) * U64(0xD6E8FEB86659FD93)))
        i = j
    return out


class Words:
    """The words of a list of texts: hashes, byte spans, and offsets by text."""

    def __init__(self, texts: list[bytes | None], lower: bool = True):
        texts = [t or b"" for t in texts]
        joined = b"\n".join(texts)
        buf = np.frombuffer(joined, dtype=np.uint8)
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.at = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1] if len(texts) else np.zeros(0, dtype=np.int64)
        edge = np.zeros(len(buf) + 2, dtype=np.int8)
        edge[1:-1] = ~_SPACE[buf]
        step = np.diff(edge)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.raw = buf
        self.buf = _LOWER[buf] if lower else buf
        #: words of text i are offsets[i]:offsets[i + 1]
        self.offsets = np.append(np.searchsorted(self.starts, self.at), len(self.starts))

    def hashes(self) -> np.ndarray:
        return hash_words(self.buf, self.starts, self.ends)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of `size` words; the caller keeps runs inside texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    total = np.zeros(n, dtype=U64)
    for k in range(size):
        total *= U64(0xFF51AFD7ED558CCD)
        total += hashes[k : k + n]
    return mix(total)


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    Fewer words than `size` make one shingle of the whole sequence; no words
    make an empty set.
    """
    hashes, out = words.hashes(), []
    runs = shingles(hashes, size)
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(shingles(hashes[a:b], b - a) ^ U64(b - a))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


def batches(batch: pa.RecordBatch, text: str, limit: int = 1 << 20):
    """Slices of a batch with about `limit` bytes of text each, one row at least."""
    column = batch.column(text)
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    part = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1 if len(part) else np.zeros(0, dtype=np.int64)
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(batch: pa.RecordBatch, text: str) -> list[bytes | None]:
    column = batch.column(text)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
