"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages (64 words each, the last may be shorter). A
passage's encoding is a tanh layer over two parts: the mean of learned vectors
of its words and word pairs, which are hashed into `BUCKETS` rows of a table,
and counts that numpy takes from the whole batch at once (shares of kinds of
bytes and words, repetition). Gated attention (Ilse et al. 2018) weighs the
passages, and the weighted encoding is scored. Word vectors, encoder, gates and
scorer are learned together from document labels; there are no passage labels.

The model is fitted on the driver on at most `TRAIN_DOCS` labelled documents,
chosen by a hash of their ids, so always the same ones: a bounded sample, of
which counts and four bytes a word reach the driver. Scores are computed for every whole text where it lies.

Nulls and others: null and empty texts are one passage of zeros, flagged
empty, and get a score; a null id is never held out nor in the training set;
labels other than 0 and 1, or of unknown documents, are not used; repeated
labels of one document count once (the lowest); with labels of one kind only
or none, all scores are that label's share, or 0.5; an empty table gives an
empty result; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import U64, Words, batches, shingles, text_bytes

TRAIN_DOCS = 6000
PASSAGE = 64
FOLDS = 5
THRESHOLD = 0.3
#: rows of the table of word vectors
BUCKETS = 1 << 14
#: kinds of bytes whose shares a passage's encoding begins with
_KINDS = [
    (65, 91),  # A-Z
    (97, 123),  # a-z
    (48, 58),  # digits
    (128, 256),  # parts of letters beyond ASCII
    (10, 11),  # line ends
    (33, 34),  # !
    (124, 125),  # |
    (35, 39),  # # $ % &
    (42, 43),  # *
    (44, 47),  # , - .
    (60, 65),  # < = > ? @
    (91, 97),  # [ \ ] ^ _ `
]
FEATURES = len(_KINDS) + 11


def held_out(key: Column) -> Column:
    """crc32 of the id as text leaves 0 by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _repeated(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether a value occurs more than once for its owner."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    same = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(h), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(h), dtype=bool)
    out[order] = twice
    return out


@dataclass
class Bags:
    """Passages of documents: counts, bounds by document, and the table rows of their words and word pairs."""

    x: np.ndarray
    offsets: np.ndarray
    words: np.ndarray  # (words, 2)
    bounds: np.ndarray  # words of passage i are bounds[i]:bounds[i + 1]

    def of(self, docs: np.ndarray) -> Bags:
        """The bags of some documents."""
        rows = _ranges(self.offsets[docs], self.offsets[docs + 1])
        sizes = self.bounds[rows + 1] - self.bounds[rows]
        spots = _ranges(self.bounds[self.offsets[docs]], self.bounds[self.offsets[docs + 1]])
        ends = np.cumsum(self.offsets[docs + 1] - self.offsets[docs])
        return Bags(self.x[rows], np.append(0, ends), self.words[spots], np.append(0, np.cumsum(sizes)))


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All of low[0]:high[0], low[1]:high[1], ..."""
    sizes = high - low
    return np.arange(sizes.sum()) + np.repeat(low - np.cumsum(sizes) + sizes, sizes)


def encode(texts: list[bytes | None]) -> Bags:
    """The bags of texts. The last word of a passage has no pair and counts twice."""
    words = Words(texts, lower=False)
    sizes = np.diff(words.offsets)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    offsets = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros((int(offsets[-1]), FEATURES))
    doc = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(offsets[-1]) - offsets[doc]
    first = words.offsets[doc] + nth * PASSAGE
    last = np.minimum(first + PASSAGE, words.offsets[doc + 1])
    full = np.flatnonzero(last > first)
    out[last <= first, -1] = 1.0
    bounds = np.append(first, len(words.starts))
    if not len(full):
        return Bags(out, offsets, np.zeros((0, 2), dtype=np.uint16), bounds)
    a, b = first[full], last[full]
    n = (b - a).astype(float)
    begin, end = words.starts[a], words.ends[b - 1]
    span = (end - begin).astype(float)
    table = np.zeros(256, dtype=np.uint8)
    for i, (low, high) in enumerate(_KINDS):
        table[low:high] = i + 1
    kinds = table[words.raw]
    total = np.zeros(len(kinds) + 1, dtype=np.int64)
    for i in range(len(_KINDS)):
        np.cumsum(kinds == i + 1, out=total[1:])
        out[full, i] = (total[end] - total[begin]) / span
    at = len(_KINDS)

    def add(values: np.ndarray) -> None:
        """The mean over each passage's words of a number for each word."""
        nonlocal at
        run = np.concatenate(([0.0], np.cumsum(values, dtype=float)))
        out[full, at] = (run[b] - run[a]) / n
        at += 1

    length = (words.ends - words.starts).astype(float)
    upper = np.concatenate(([0], np.cumsum(kinds == 1)))
    lower = np.concatenate(([0], np.cumsum(kinds == 2)))
    ups, lows = (c[words.ends] - c[words.starts] for c in (upper, lower))
    hashes = words.hashes()
    owner = np.repeat(np.arange(len(texts)), sizes)
    add(length / 10.0)
    add(length == 1)
    add(length > 12)
    add(ups > 0)
    add((ups > 1) & (lows == 0))
    add((ups + lows) == 0)
    passage = np.repeat(np.arange(len(full)), b - a)
    add(_repeated(hashes, passage))
    runs = shingles(hashes, 3)
    inside = np.zeros(len(hashes), dtype=bool)
    if len(runs):
        whole = owner[:-2] == owner[2:]
        spots = np.flatnonzero(whole)
        inside[spots] = _repeated(runs[spots], owner[spots])
    add(inside)
    add(_repeated(hashes ^ U64(1), owner))
    out[full, at] = np.log1p(n) / 4.0
    pairs = hashes.copy()
    pairs[:-1] = shingles(hashes, 2)
    pairs[b - 1] = hashes[b - 1]
    return Bags(out, offsets, (np.stack([hashes, pairs], axis=1) % U64(BUCKETS)).astype(np.uint16), bounds)


def _softmax(scores: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    e = np.exp(scores - np.maximum.reduceat(scores, starts)[doc])
    return e / np.add.reduceat(e, starts)[doc]


class Model:
    """Encoder, gated attention and scorer; plain numpy arrays."""

    def __init__(self, hidden: int = 16, gates: int = 8, seed: int = 7):
        draw = np.random.default_rng(seed).normal
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.p = {
            "We": draw(0, FEATURES**-0.5, (FEATURES, hidden)), "be": np.zeros(hidden),
            "V": draw(0, hidden**-0.5, (hidden, gates)), "bv": np.zeros(gates),
            "U": draw(0, hidden**-0.5, (hidden, gates)), "bu": np.zeros(gates),
            "w": draw(0, gates**-0.5, gates), "c": draw(0, hidden**-0.5, hidden), "b": np.zeros(1),
        }
        self.table = np.zeros((BUCKETS, hidden), dtype=np.float32)
        self.constant: float | None = None

    def lexical(self, bags: Bags) -> np.ndarray:
        """The mean vector of each passage's words and pairs, zeros without words."""
        out = np.zeros((len(bags.x), self.table.shape[1]))
        full = np.flatnonzero(np.diff(bags.bounds))
        if len(full):
            vectors = self.table[bags.words[:, 0]] + self.table[bags.words[:, 1]]
            out[full] = np.add.reduceat(vectors, bags.bounds[full], axis=0) / (2.0 * np.diff(bags.bounds)[full, None])
        return out

    def forward(self, bags: Bags) -> dict:
        p, starts = self.p, bags.offsets[:-1]
        doc = np.repeat(np.arange(len(starts)), np.diff(bags.offsets))
        x = np.clip((bags.x - self.mean) / self.scale, -6.0, 6.0)
        h = np.tanh(x @ p["We"] + self.lexical(bags) + p["be"])
        v = np.tanh(h @ p["V"] + p["bv"])
        u = 1.0 / (1.0 + np.exp(-(h @ p["U"] + p["bu"])))
        a = _softmax((v * u) @ p["w"], starts, doc)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "doc": doc, "starts": starts, "score": 1.0 / (1.0 + np.exp(-(z @ p["c"] + p["b"])))}

    def gradient(self, f: dict, y: np.ndarray, decay: float) -> dict:
        p, doc, starts = self.p, f["doc"], f["starts"]
        dl = (f["score"] - y) / len(y)
        dz = dl[:, None] * p["c"]
        dh = f["a"][:, None] * dz[doc]
        da = (f["h"] * dz[doc]).sum(axis=1)
        ds = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[doc])
        dg = ds[:, None] * p["w"]
        dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
        dh = dh + dv @ p["V"].T + du @ p["U"].T
        de = dh * (1 - f["h"] ** 2)
        f["de"] = de
        out = {"We": f["x"].T @ de, "be": de.sum(0), "V": f["h"].T @ dv, "bv": dv.sum(0), "U": f["h"].T @ du, "bu": du.sum(0), "w": (f["v"] * f["u"]).T @ ds, "c": f["z"].T @ dl, "b": dl.sum(keepdims=True)}
        return {k: g + decay * p[k] for k, g in out.items()}

    def table_gradient(self, f: dict, bags: Bags) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the table that the bags use, and their gradient; after gradient()."""
        sizes = np.diff(bags.bounds)
        part = (f["de"] / (2.0 * np.maximum(1, sizes))[:, None]).astype(np.float32)
        rows = bags.words.ravel()
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        owner = np.repeat(np.arange(len(sizes)), sizes)[order // 2]
        return rows[first], np.add.reduceat(part[owner], first, axis=0) if len(first) else part[:0]

    def fit(self, bags: Bags, y: np.ndarray, *, epochs: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-5, lexical_rate: float = 0.1, seed: int = 11) -> Model:
        """Adam for the layers, Adagrad for the table of word vectors."""
        if not len(y) or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.5
            return self
        self.mean, self.scale = bags.x.mean(axis=0), bags.x.std(axis=0) + 1e-3
        rng = np.random.default_rng(seed)
        m, s = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        seen = np.zeros_like(self.table)
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                docs = order[i : i + batch]
                part = bags.of(docs)
                f = self.forward(part)
                grads = self.gradient(f, y[docs], decay)
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
                rows, g = self.table_gradient(f, part)
                seen[rows] += g * g
                self.table[rows] -= lexical_rate * g / (np.sqrt(seen[rows]) + 1e-8)
        return self

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return np.round(self.forward(encode(texts))["score"], 6) if len(texts) else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", key: str = "doc_id", text: str = "text", most: int = TRAIN_DOCS) -> Model:
    """Fits on labelled documents that are not held out, `most` at most."""
    told = labels.filter(~held_out(F.col(key)) & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"))
    sample = told.filter("k is not null").orderBy(F.xxhash64("k"), "k").limit(most)
    few = docs.sparkSession.createDataFrame([tuple(r) for r in sample.collect()], told.schema)  # `most` rows at most
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(few), "k")

    def features(stream):
        for whole in stream:
            for batch in batches(whole, "t"):
                bags = encode(text_bytes(batch, "t"))
                spans = list(zip(bags.offsets[:-1], bags.offsets[1:], strict=True))
                rows = [bags.x[a:b].astype(np.float32).tobytes() for a, b in spans]
                words = [bags.words[bags.bounds[a] : bags.bounds[b]].tobytes() for a, b in spans]
                yield pa.RecordBatch.from_arrays([batch.column("k").cast(pa.int64()), batch.column("y").cast(pa.float64()), pa.array(rows, pa.binary()), pa.array(words, pa.binary())], ["k", "y", "x", "w"])

    found = texts.mapInArrow(features, "k long, y double, x binary, w binary").collect()
    found = sorted(found, key=lambda r: (r["k"], bytes(r["x"]), bytes(r["w"])))  # in an order of its own: reruns agree
    xs = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, FEATURES).astype(float) for r in found]
    words = [np.frombuffer(r["w"], dtype=np.uint16).reshape(-1, 2) for r in found]
    none = [np.zeros((0, FEATURES))], [np.zeros((0, 2), dtype=np.uint16)]
    # passages have PASSAGE words but for a text's last
    sizes = [np.minimum(PASSAGE, len(w) - PASSAGE * np.arange(len(x))) for x, w in zip(xs, words, strict=True)]
    bags = Bags(np.concatenate(xs or none[0]), np.append(0, np.cumsum([len(x) for x in xs], dtype=np.int64)), np.concatenate(words or none[1]), np.append(0, np.cumsum(np.concatenate([np.zeros(0, dtype=np.int64), *sizes]))).astype(np.int64))
    return Model().fit(bags, np.array([r["y"] for r in found]))


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def judge(stream):
        for whole in stream:
            for batch in batches(whole, "t"):
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(model.scores(text_bytes(batch, "t")))], [key, "score"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(judge, f"`{key}` {kind}, score double")


def good(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, unchanged."""
    names, schema = docs.columns, docs.schema

    def keep(stream):
        for whole in stream:
            for batch in batches(whole, text):
                yield batch.filter(pa.array(model.scores(text_bytes(batch, text)) >= threshold))

    return docs.select(*names).mapInArrow(keep, schema)
