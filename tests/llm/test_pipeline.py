"""The pipeline's stages, each on all that its predecessor kept, against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from nearfield.llm import quality
from nearfield.llm.common import read_table
from nearfield.llm.queries import tokenizer_path
from nearfield.llm.words import Words, shingles

from .test_results import WORD, brute, plain_targets, shingle_set

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Rows of documents, and of each stage."""
    at = tmp_path_factory.mktemp("stages")
    rows = read_table(spark, SF, "documents")
    out = {"documents": rows.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, SF).write.parquet(str(at / name))
        rows = spark.read.parquet(str(at / name))
        out[name] = rows.collect()
    return out


def features(text):
    """The encoding of each passage of a text, a word at a time."""
    raw = (text or "").encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    tokens = [raw[a:b] for a, b in spans]
    runs = [tuple(tokens[i : i + 3]) for i in range(len(tokens) - 2)]
    again, in_text = Counter(runs), Counter(tokens)
    out = []
    for first in range(0, max(1, len(spans)), quality.PASSAGE):
        part = tokens[first : first + quality.PASSAGE]
        if not part:
            out.append([0.0] * (quality.FEATURES - 1) + [1.0])
            continue
        piece = raw[spans[first][0] : spans[first + len(part) - 1][1]]
        kinds = [sum(low <= c < high for c in piece) / len(piece) for low, high in quality._KINDS]
        ups = [sum(65 <= c < 91 for c in t) for t in part]
        lows = [sum(97 <= c < 123 for c in t) for t in part]
        in_part = Counter(part)
        flags = [
            [len(t) / 10 for t in part],
            [len(t) == 1 for t in part],
            [len(t) > 12 for t in part],
            [u > 0 for u in ups],
            [u > 1 and n == 0 for u, n in zip(ups, lows, strict=True)],
            [u + n == 0 for u, n in zip(ups, lows, strict=True)],
            [in_part[t] > 1 for t in part],
            [first + i < len(runs) and again[runs[first + i]] > 1 for i in range(len(part))],
            [in_text[t] > 1 for t in part],
        ]
        out.append([*kinds, *(sum(f) / len(part) for f in flags), math.log1p(len(part)) / 4, 0.0])
    return out


def lexical(model, text):
    """The mean word vector of each passage, a word at a time."""
    tokens = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    out = []
    for first in range(0, max(1, len(tokens)), quality.PASSAGE):
        part = [Words([t], lower=False).hashes() for t in tokens[first : first + quality.PASSAGE]]
        pairs = [shingles(np.concatenate(two), 2) for two in zip(part, part[1:], strict=False)] + part[-1:]
        vectors = [model.table[int(h[0]) % quality.BUCKETS].tolist() for h in part + pairs]
        out.append([sum(v[k] for v in vectors) / max(1, len(vectors)) for k in range(model.table.shape[1])])
    return out


def score(model, text):
    """The gated attention, a passage and a number at a time."""
    p, hidden, weights = model.p, [], []
    for x, own in zip(features(text), lexical(model, text), strict=True):
        x = [min(6.0, max(-6.0, (v - m) / s)) for v, m, s in zip(x, model.mean, model.scale, strict=True)]
        h = [math.tanh(sum(v * w for v, w in zip(x, column, strict=True)) + e + b) for column, e, b in zip(p["We"].T, own, p["be"], strict=True)]
        v = [math.tanh(sum(a * w for a, w in zip(h, column, strict=True)) + b) for column, b in zip(p["V"].T, p["bv"], strict=True)]
        u = [1 / (1 + math.exp(-sum(a * w for a, w in zip(h, column, strict=True)) - b)) for column, b in zip(p["U"].T, p["bu"], strict=True)]
        hidden.append(h)
        weights.append(math.exp(sum(a * b * w for a, b, w in zip(v, u, p["w"], strict=True))))
    share = [w / sum(weights) for w in weights]
    z = [sum(a * h[k] for a, h in zip(share, hidden, strict=True)) for k in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-sum(a * c for a, c in zip(z, p["c"], strict=True)) - p["b"][0]))


def test_quality(spark, tables):
    docs = read_table(spark, SF, "documents")
    model = quality.fit(docs, read_table(spark, SF, "labels"))
    want = {r["doc_id"]: score(model, r["text"]) for r in tables["documents"]}
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)
    assert {r["doc_id"] for r in tables["quality"]} == {i for i, s in want.items() if s >= quality.THRESHOLD}
    assert 0 < len(tables["quality"]) < len(tables["documents"])


def test_near_dedup(tables):
    rows = tables["quality"]
    component = brute({r["doc_id"]: shingle_set(r["text"], 5) for r in rows}, 80)
    assert sorted(tables["near_dedup"]) == sorted(r for r in rows if component[r["doc_id"]] == r["doc_id"])
    assert len(tables["near_dedup"]) < len(rows)


def test_decontaminate(spark, tables):
    """The items of this table stand in documents as they are, or with other values for their own."""
    plain = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    items = [plain(r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    leaky = {r["doc_id"] for r in tables["near_dedup"] if any(i in plain(r["text"]) for i in items)}
    kept = {r["doc_id"] for r in tables["decontaminate"]}
    rest = {r["doc_id"] for r in tables["near_dedup"]} - leaky
    assert leaky and not kept & leaky
    # what goes besides shares most five-word windows of an item
    grams = lambda t: {tuple(w[j : j + 5]) for w in [t.split()] for j in range(len(w) - 4)}
    wanted = [grams(i) for i in items]
    for r in tables["near_dedup"]:
        if r["doc_id"] in rest - kept:
            own = grams(plain(r["text"]))
            assert any(w and len(w & own) >= 0.5 * len(w) for w in wanted), r["doc_id"]


def test_mix(tables):
    rows = tables["decontaminate"]
    sizes, by = Counter(), {r["doc_id"]: r for r in rows}
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    target, copies, taken = plain_targets(dict(sizes)), Counter(), Counter()
    for r in tables["mix"]:
        assert r == by[r["doc_id"]]
        copies[r["doc_id"]] += 1
        taken[r["source"]] += len(WORD.findall(r["text"] or ""))
    longest, close = defaultdict(int), 0
    for r in rows:
        rate = min(2.0, target[r["source"]] / max(1, sizes[r["source"]]))  # one margin: the tilt is the ratio
        # a class of sizes shifts its rounding by 1 at most, to make up for larger documents
        assert copies[r["doc_id"]] <= 2 and abs(copies[r["doc_id"]] - rate) < 2
        close += copies[r["doc_id"]] in (math.floor(rate), math.ceil(rate))
        longest[r["source"]] = max(longest[r["source"]], len(WORD.findall(r["text"] or "")))
    assert close >= 0.8 * len(rows)
    assert all(abs(taken[s] - target[s]) <= max(0.01 * target[s], longest[s] / 2) for s in target)


def test_tokens(tables):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want, at = [], 0
    for r in sorted(tables["mix"], key=lambda r: r["doc_id"]):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in tables["tokens"]) == sorted(want)


def test_run_is_the_chain(spark, tables):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in tables["tokens"])
