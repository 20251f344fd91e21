"""Exact token ids of the tokenizers library at the cost of distinct words.

For a tokenizer that drops white space and splits letters from punctuation
before a byte-level model with word ends, the ids of a text are those of its
pieces between ASCII white space, one after another. Arrow splits a batch and
finds its distinct pieces; only pieces not met before are encoded, by the
tokenizer's own normalizer, pre-tokenizer and model.
"""

from __future__ import annotations

import itertools
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache

#: Distinct pieces that are remembered; beyond it those met once are forgotten, which costs time and changes no result.
REMEMBERED = 200_000
#: New pieces that are prepared together.
TOGETHER = 1024


def _visible() -> dict[int, str]:
    """The byte-level alphabet: bytes that print stand for themselves, the others for code points from 256 up."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(256 + i) for i, b in enumerate(others)}


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """The array, enlarged if it has fewer than n places."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(len(x), n - len(x)), dtype=x.dtype)])


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.visible = _visible()
        self.points = np.array([ord(self.visible.get(b, chr(b))) for b in range(256)], dtype="<u4")
        self._empty()

    def _empty(self) -> None:
        self.known = pa.array([], pa.string())  # a piece's place is its row
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.size = np.zeros(1 << 16, dtype=np.int64)
        self.met = np.zeros(1 << 16, dtype=np.int32)  # slices of text that had the piece

    def _forget(self) -> None:
        """Keeps the pieces that several slices had, if they are fewer than half of those allowed."""
        n = len(self.known)
        often = np.flatnonzero(self.met[:n] > 1)
        known, size, flat, start = self.known, self.size[often], self.flat, self.start[often]
        self._empty()
        if len(often) > REMEMBERED // 2:
            return
        total = np.cumsum(size)
        self.used = int(total[-1]) if len(total) else 0
        self.flat, self.start, self.size, self.met = _room(self.flat, self.used), _room(self.start, len(often)), _room(self.size, len(often)), _room(self.met, len(often))
        self.flat[: self.used] = flat[np.repeat(start - (total - size), size) + np.arange(self.used)]
        self.start[: len(often)], self.size[: len(often)], self.met[: len(often)] = total - size, size, 1
        self.known = known.take(pa.array(often))

    @staticmethod
    def of(path: str) -> PieceEncoder:
        store = worker_cache()
        if ("pieces", path) not in store:
            store["pieces", path] = PieceEncoder(path)
        return store["pieces", path]

    def _ids(self, piece: str) -> list[int]:
        """The tokenizer's own steps, one by one; plain words need only the last."""
        model = self.tokenizer.model
        if piece.isascii() and piece.isalpha():  # A-Z are lower-cased before
            return [t.id for t in model.tokenize(piece)]
        low = piece.lower()
        # lower() looks at a sigma's neighbours, the tokenizer doesn't
        if low.isalpha() and "\u03a3" not in piece and unicodedata.is_normalized("NFC", piece) and unicodedata.is_normalized("NFC", low):
            return [t.id for t in model.tokenize(low.encode().decode("latin-1").translate(self.visible))]
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(piece))
        return [t.id for word, _ in words for t in model.tokenize(word)]

    def _all_ids(self, pieces: list[str]) -> list[list[int]]:
        """As `_ids` of each; those in normal form are lower-cased and spelt in bytes together, lines apart."""
        whole = "\n".join(pieces)
        low = whole.lower()
        if "\u03a3" in whole or not (unicodedata.is_normalized("NFC", whole) and unicodedata.is_normalized("NFC", low)):
            return [self._ids(p) for p in pieces]
        spelt = self.points[np.frombuffer(low.encode(), dtype=np.uint8)].tobytes().decode("utf-32-le").split(self.visible[10])
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(s)] if x.isalpha() else self._ids(p) for p, x, s in zip(pieces, low.split("\n"), spelt, strict=True)]

    def _learn(self, pieces: pa.Array) -> None:
        listed = pieces.to_pylist()
        found = [ids for at in range(0, len(listed), TOGETHER) for ids in self._all_ids(listed[at : at + TOGETHER])]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum()))
        row, used = len(self.known), self.used
        self.flat = _room(self.flat, used + len(ids))
        self.start, self.size, self.met = (_room(x, row + len(found)) for x in (self.start, self.size, self.met))
        self.flat[used : used + len(ids)] = ids
        self.start[row : row + len(found)] = used + np.cumsum(sizes) - sizes
        self.size[row : row + len(found)] = sizes
        self.used += len(ids)
        self.known = pa.concat_arrays([self.known, pieces])

    def _rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each piece of each text its row in the memory; offsets by text."""
        if len(self.known) > REMEMBERED:
            self._forget()
        column = pc.ascii_lower(pc.fill_null(column, "").cast(pa.string()))
        # marks after a word are pieces of their own anyway, if none is an apostrophe; set apart, words repeat more often
        column = pc.replace_substring_regex(column, pattern=r"([a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}])([!-&(-/:-@\[-`{-~]+)(\s|$)", replacement=r"\1 \2\3")
        pieces = pc.ascii_split_whitespace(column)
        coded = pieces.flatten().dictionary_encode()
        places = pc.index_in(coded.dictionary, value_set=self.known)
        new = np.flatnonzero(places.is_null().to_numpy(zero_copy_only=False))
        at = places.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if new.size:
            at[new] = len(self.known) + np.arange(new.size)
            self._learn(coded.dictionary.take(pa.array(new)))
        self.met[at] += 1
        offsets = np.asarray(pieces.offsets, dtype=np.int64)
        return at[np.asarray(coded.indices)] if len(at) else np.zeros(0, dtype=np.int64), offsets - offsets[0]

    def counts(self, column: pa.Array) -> np.ndarray:
        rows, offsets = self._rows(column)
        total = np.concatenate(([0], np.cumsum(self.size[rows])))
        return total[offsets[1:]] - total[offsets[:-1]]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), and offsets by text."""
        rows, offsets = self._rows(column)
        sizes = self.size[rows]
        total = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.start[rows] - total[:-1], sizes) + np.arange(total[-1])
        return self.flat[at], total[offsets]
