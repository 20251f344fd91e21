"""Results against brute force, round trips and held-out labels."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.llm import idcoder, quality, queries
from nearfield.llm.decontaminate import decontaminated, leaks
from nearfield.llm.graph import components
from nearfield.llm.common import Scratch
from nearfield.llm.minhash import band_rows, minima, near_duplicates
from nearfield.llm.mixing import balanced_rates, mix_copies, source_targets
from nearfield.llm.substring import compact_windows, passages, repeated_passages
from nearfield.llm.token_rollup import Rollup, count_tokens, revised, signed
from nearfield.llm.tokens import PieceEncoder
from nearfield.llm.url_filter import Automaton
from nearfield.llm.warc import BundleReader, BundleWriter, parse, record
from nearfield.llm.words import U64

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


# 1 mixing


def plain_targets(sizes):
    """Targets of source_targets by halving: the level at which weights, stopped at twice the sizes, give 1.5 times all words."""
    order = sorted(sizes, key=lambda v: (v is None, v or ""))
    weight = {v: (5, 2, 1)[i % 3] for i, v in enumerate(order)}
    low, high = 0.0, 2.0 * sum(sizes.values()) + 1
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(2 * sizes[v], level * weight[v]) for v in sizes) < 1.5 * sum(sizes.values()):
            low = level
        else:
            high = level
    return {v: min(2.0 * sizes[v], high * weight[v]) for v in sizes}


def test_targets(spark):
    r = random.Random(3)
    many = {chr(r.randint(33, 0x1F600)) + str(i): r.randint(0, 10_000) for i in range(500) if not 0xD800 <= i < 0xE000}
    many = {k: v for k, v in many.items() if not 0xD800 <= ord(k[0]) < 0xE000}
    cases = [{}, {None: 7}, {"a": 0, None: 0}, {"a": 5, "b": 5, "c": 5}, {"": 1, "é": 10_000, "z": 3, "Z": 9, None: 400}, {"\U0001f600": 50, "\uffee": 60, "b": 1000}, many]
    for sizes in cases:
        table = spark.createDataFrame(list(sizes.items()), "value string, words long")
        got = {row["value"]: row["target"] for row in source_targets(table).collect()}
        assert got == pytest.approx(plain_targets(sizes), rel=1e-9, abs=1e-9)
        assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))
        assert all(got[v] <= 2 * n for v, n in sizes.items())


def rates_of(spark, cells, targets):
    width = len(targets)
    names = [f"c{i}" for i in range(width)]
    table = spark.createDataFrame([(*c, n) for c, n in cells], ", ".join([*(f"{c} string" for c in names), "n long"]))
    goals = [spark.createDataFrame(list(t.items()), "value string, target double") for t in targets]
    return {tuple(r[:width]): r["rate"] for r in balanced_rates(table, names, goals, 2.0).collect()}


def test_newton_meets_two_margins(spark):
    r = random.Random(5)
    cells = [((a, b), r.randint(10, 1000)) for a in "abcd" for b in "xyz"]
    want = {c: r.uniform(0.3, 1.8) for c, _ in cells}
    targets = [defaultdict(float), defaultdict(float)]
    for c, n in cells:
        for m in (0, 1):
            targets[m][c[m]] += want[c] * n
    rate = rates_of(spark, cells, [dict(t) for t in targets])
    for m in (0, 1):
        for v, goal in targets[m].items():
            assert sum(rate[c] * n for c, n in cells if c[m] == v) == pytest.approx(goal, rel=1e-6)


def test_newton_with_many_values(spark):
    """One margin: the rate of a value is target / words, at most 2; nulls, no words and no target included."""
    r = random.Random(6)
    cells = [((f"s{i}",), r.randint(1, 1000)) for i in range(3000)] + [((None,), 17), (("none",), 0), (("nil",), 5), (("full",), 8), (("over",), 8), (("free",), 9)]
    goals = {v: n * r.uniform(0.001, 2) for (v,), n in cells} | {"none": 0.0, "nil": 0.0, "full": 16.0, "over": 99.0}
    del goals["free"]
    rate = rates_of(spark, cells, [goals])
    assert len(rate) == len(cells) and rate[("free",)] == 1.0
    for (v,), n in cells:
        if n and v != "free":
            assert rate[(v,)] == pytest.approx(min(2.0, goals[v] / n), rel=1e-5, abs=1e-6), v


def test_mix_comes_near_its_targets(spark):
    out = queries.op1_mix_sources(spark, "/root/testdata/sf0.01").toPandas()
    assert len(out) == 1000 and (out["taken"] <= 2 * out["size"]).all()
    by = out.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), told=("source_size", "first"))
    assert (by["size"] == by["told"]).all()
    assert (abs(by["taken"] - by["target"]) <= 0.005 * by["target"] + 5).all()
    assert abs(by["taken"].sum() / (1.5 * by["size"].sum()) - 1) < 0.002
    two = mix_copies(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), margins=("source", "lang"), targets_of=lambda s: [m.select("value", (1.2 * F.col("words")).alias("target")) for m in s]).toPandas()
    for m in ("source", "lang"):
        got = two.assign(t=two["size"] * two["copies"]).groupby(m)[["t", "size"]].sum()
        assert (abs(got["t"] / got["size"] - 1.2) < 0.03).all()


# 2 URL filters


@given(st.lists(st.text("ab/*.", min_size=1, max_size=6).filter(lambda g: g.strip("*")), min_size=1, max_size=30), st.lists(st.text("ab/.", max_size=9), max_size=8))
@settings(max_examples=150, deadline=None)
def test_automaton_is_a_glob_matcher(globs, texts):
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    got = Automaton(globs).match([t.encode() for t in texts])
    for k, g in enumerate(globs):
        pattern = "".join({"**": "(?s:.*)", "*": "[^/]*"}.get(p, re.escape(p)) for p in re.findall(r"\*\*|\*|[^*]+", g))
        for i, t in enumerate(texts):
            assert bool(got[i, k]) == bool(re.fullmatch(pattern, t)), (g, t)


def test_many_rules_and_words():
    rules = [f"*.h{i}.com/p{i}**" for i in range(300)]
    a = Automaton(rules)
    assert a.words > 40
    m = a.match([b".x.h250.com/p250/q", b".h25.com/p250"])
    assert m[0].nonzero()[0].tolist() == [250] and not m[1].nonzero()[0].tolist() == [250]


# 3 decontamination


def test_leaks_agree_with_containment(spark, documents):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    plain = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    texts = {i: plain(t) for i, t in documents.items()}
    want = {(i, j) for j, t in items.items() for i, d in texts.items() if plain(t) in d}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontaminate(spark, SMALL).collect()}
    assert want <= got and len(got - want) <= 1


def test_other_values_same_question(spark):
    item = "Last week Alice bought 3,000 kg of red apples for 12 dollars and Alice gave 7 apples to her friend Bob in the market"
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = "So. " + item.replace("Alice", "Zoe").replace("3,000 kg", "41 kg").replace("12", "99").replace("Bob", "Yan") + ". And more words follow here."
    mixed = item.replace("Alice bought", "Zoe bought")
    half = "nothing of " + " ".join(item.split()[:8]) + " but then other words come that have no part in it at all"
    docs = spark.createDataFrame(list(enumerate([item, other, item.upper(), half, "clean words only"])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in leaks(docs, b).collect()}
    assert {0, 1} <= set(got) and not {3, 4} & set(got)
    assert got[1]["slots"] == 1.0 and got[1]["coverage"] > 0.9
    loose = leaks(spark.createDataFrame([(0, mixed)], "doc_id long, text string"), b).first()
    assert loose is None or loose["slots"] < 1.0
    two = item.replace("Alice bought", "Zoe bought").replace("Alice gave", "Yan gave").replace("12", "99").replace("3,000", "41")
    one = item.replace("Alice", "Zoe").replace("12", "55").replace("3,000", "55").replace("Bob", "Yan")
    later = other.replace("apples for", "apples that were ripe for")
    docs = spark.createDataFrame(list(enumerate([two, one, later])), "doc_id long, text string")
    assert {r["doc_id"]: r["slots"] for r in leaks(docs, b).collect()} == {2: 1.0}


def test_rows_without_an_id_and_texts_of_one_id(spark):
    first, second = "one plain question about the colour of the evening sky over town", "quite another question about boats that cross the wide river at night"
    b = spark.createDataFrame([(None, first), (1, first), (1, second)], "item_id long, text string")
    rows = [(None, first), (None, "clean words that no item has"), (5, "clean words of another sort"), (5, f"x {second} y"), (6, first.split("the")[0]), (6, first.split("colour")[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r["doc_id"], r["item_id"]) for r in leaks(docs, b).collect()), key=repr) == sorted([(None, None), (None, 1), (5, 1)], key=repr)
    assert {tuple(r) for r in decontaminated(docs, b).collect()} == {rows[1], rows[2], rows[4], rows[5]}


def test_items_dense_in_values_and_short_items(spark):
    items = [(1, "Compute 12 + 7 x 3 - 5 + 18"), (2, "Share 3 kg, 5 kg and 7 kg among Ann, Bob and Sue"), (3, "What is 12 + 35?")]
    b = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, f"Some words go before. {t} And others follow here.") for i, t in items] + [(4, "What is 12 and what is 35? Share 3 kg of it.")]
    got = {(r["doc_id"], r["item_id"]) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}


# 4 token files


@given(st.lists(st.integers(0, 65535), max_size=400), st.integers(1, 60))
@settings(max_examples=40, deadline=None)
def test_coder_round_trip(ids, repeat):
    x = np.array(ids * repeat, dtype=np.uint32)[:5000]
    assert (idcoder.decode_block(idcoder.encode_block(x)) == x).all()


def test_coder_detects_damage_and_compresses():
    r = np.random.default_rng(0)
    x = r.zipf(1.3, 60_000).clip(0, 40_000).astype(np.uint32)
    raw = idcoder.encode_block(x)
    assert len(raw) < 1.3 * len(x)
    broken = bytearray(raw)
    broken[-200] ^= 255
    with pytest.raises(ValueError, match="checksum"):
        idcoder.decode_block(bytes(broken))
    wide = np.array([70_000, 0, 2**32 - 1, 65_536, 65_535] * 300, dtype=np.uint32)
    raw = bytearray(idcoder.encode_block(wide))
    assert (idcoder.decode_block(bytes(raw)) == wide).all() and len(raw) < wide.nbytes
    raw[14] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        idcoder.decode_block(bytes(raw))


@given(st.lists(st.text(max_size=40), max_size=6))
@settings(max_examples=200, deadline=None)
def test_pieces_have_the_tokenizers_ids(texts):
    import pyarrow as pa

    e = PieceEncoder.of(queries.tokenizer_path())
    ids, at = e.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
    assert e.counts(pa.array(texts, pa.string())).tolist() == np.diff(at).tolist()


def test_forgotten_pieces_are_learnt_again(monkeypatch):
    import pyarrow as pa

    from nearfield.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    e, r = tokens.PieceEncoder(queries.tokenizer_path()), random.Random(2)
    for _ in range(12):
        texts = [" ".join(f"{r.choice(['apple', 'pear', 'plum'])} x{r.randrange(10**6)}" for _ in range(8)) for _ in range(3)]
        ids, at = e.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_marks_after_words_are_set_apart():
    """Ids are the library's, and a word is learned once, whatever marks follow it."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = ["word word!! word### word$$$", "caf\u00e9. caf\u00e9!! \u00c9!!", "it's. a'b!! can't! x'!! a. 's", "\u0130!! \u03a3\u0391\u03a3! \u0149$", "a\u2260 e\u0301!! x!\u0301 y=\u0338", "a!!\u200d b a-- --b 5!! a5!! a!5", "cd!\x0bab!\x1f \u00ff~~ \u0100^_`"]
    encoder = PieceEncoder(path)
    import pyarrow as pa

    ids, at = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    known = set(encoder.known.to_pylist())
    assert {"word", "!!", "caf\u00e9"} <= known and not known & {"word!!", "word###", "caf\u00e9!!"}


def test_token_files(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    got = {r["doc_id"]: r for r in queries.op4_token_files(spark, SMALL).collect()}
    at = 0
    for i in sorted(documents):
        ids = [*t.encode(documents[i] or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# 5 fingerprints


def jaccard(a, b):
    a, b = (Counter(re.split(r"[\x20\x09-\x0D]+", x.lower())) for x in (a, b))
    for c in (a, b):
        c.pop("", None)
    keys = {*a, *b}
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_fingerprints(spark, documents):
    got = {r["doc_id"]: r for r in queries.op5_fingerprints(spark, SMALL).collect()}
    order, errors = sorted(documents), []
    for i, following in zip(order, order[1:] + order[:1], strict=True):
        t, n = documents[i] or "", documents[following] or ""
        k = len(t) // 4
        e = t[: len(t) - k] + n[:k]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        errors += [got[i]["near_edited"] - jaccard(t, e), got[i]["near_next"] - jaccard(t, n)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.08
    same = defaultdict(set)
    for i in order:
        same[documents[i]].add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())


# 6 quality


def test_gradient():
    m = quality.Model(hidden=5, gates=3)
    r = np.random.default_rng(0)
    sizes = np.array([3, 0, 5, 1, 2, 4, 1, 1, 6, 2, 3, 2])
    bags = quality.Bags(r.normal(size=(12, quality.FEATURES)), np.array([0, 3, 4, 12]), r.integers(0, 9, (sizes.sum(), 2)).astype(np.uint16), np.append(0, np.cumsum(sizes)))
    m.table = r.normal(size=m.table.shape)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        got = m.forward(bags)["score"]
        return float(-np.mean(y * np.log(got) + (1 - y) * np.log(1 - got)))

    f = m.forward(bags)
    grads = m.gradient(f, y, 0.0)
    rows, table = m.table_gradient(f, bags)
    assert rows.tolist() == sorted(set(bags.words.ravel().tolist()))
    checks = [(m.p[name], at, g[at]) for name, g in grads.items() for at in [tuple(r.integers(0, n) for n in g.shape)]]
    checks += [(m.table, (row, 2), g[2]) for row, g in zip(rows, table, strict=True)]
    for values, at, g in checks:
        keep, step = values[at], 1e-6
        values[at] = keep + step
        high = loss()
        values[at] = keep - step
        low = loss()
        values[at] = keep
        assert g == pytest.approx((high - low) / (2 * step), abs=1e-5), at


def test_words_alone_tell_quality():
    """Two vocabularies whose words look alike: only learned words can tell them apart."""
    r = random.Random(8)
    names = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(600)]
    draw = lambda good: " ".join(r.choice(names[:300] if good == (r.random() < 0.7) else names[300:]) for _ in range(r.randint(40, 200))).encode()
    y = np.array([r.random() < 0.5 for _ in range(1500)], dtype=float)
    texts = [draw(bool(v)) for v in y]
    model = quality.Model().fit(quality.encode(texts[:1000]), y[:1000])
    assert ((model.scores(texts[1000:]) >= 0.5) == y[1000:]).mean() > 0.95
    plain = quality.Model().fit(quality.encode(texts[:1000]), y[:1000], lexical_rate=0.0)
    assert ((plain.scores(texts[1000:]) >= 0.5) == y[1000:]).mean() < 0.7


def test_bags_of_some_documents():
    texts = [b"a b c", None, b"x " * 130, b"", b"y z"]
    bags = quality.encode(texts)
    picked = bags.of(np.array([4, 2, 1]))
    again = quality.encode([texts[4], texts[2], texts[1]])
    for name in ("x", "offsets", "words", "bounds"):
        assert np.allclose(getattr(picked, name), getattr(again, name), rtol=0, atol=1e-12), name


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op6_quality(spark, sf).toPandas()
    told = out.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    unseen = told[told["held_out"]]
    assert (out["held_out"] == out["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (unseen["predicted"] == unseen["quality"]).mean() > 0.98
    assert (unseen[unseen["quality"] == 1]["predicted"] == 1).mean() > 0.99
    assert (unseen[unseen["quality"] == 0]["predicted"] == 0).mean() > 0.9


# 7 passages


@given(st.lists(st.integers(1, 2**63), min_size=1, max_size=120, unique=True), st.integers(2, 20))
@settings(max_examples=60, deadline=None)
def test_compact_windows(values, width):
    h = np.array(values, dtype=U64)
    want = []
    for c in range(len(h)):
        low, high = c, c
        while low > 0 and h[low - 1] > h[c]:
            low -= 1
        while high < len(h) - 1 and h[high + 1] > h[c]:
            high += 1
        if high - low + 1 >= width:
            want.append((low, c, high))
    assert want == list(zip(*(x.tolist() for x in compact_windows(h, width)), strict=True))
    two = np.concatenate([h, [0], h]).astype(U64)
    n = len(h) + 1
    assert list(zip(*(x.tolist() for x in compact_windows(two, width)), strict=True)) == want + [(a + n, b + n, c + n) for a, b, c in want]


def test_passages_find_repeats(spark, documents):
    seen = defaultdict(set)
    for i, t in documents.items():
        w = words(t)
        for j in range(len(w) - 49):
            seen[tuple(w[j : j + 50])].add(i)
    want = {i for s in seen.values() for i in s - {min(s)}}
    got = queries.op7_passages(spark, SMALL).collect()
    assert want <= {r["doc_id"] for r in got}
    for r in got:
        a, b = words(documents[r["source_doc_id"]])[r["source_start"] : r["source_end"]], words(documents[r["doc_id"]])[r["start_word"] : r["end_word"]]
        assert r["source_doc_id"] < r["doc_id"] and len(b) == r["n_words"] >= 50
        p, q = ({tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (a, b))
        assert len(p & q) / len(p | q) == pytest.approx(r["similarity"], abs=1e-6) and r["similarity"] >= 0.8


def test_altered_and_hot_passages(spark):
    r = random.Random(4)
    new = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    common, line = new(70), new(30)
    docs = []
    for i in range(60):
        body = new(40) + (common if i % 2 else line) + new(40)
        docs.append((i, " ".join(body)))
    altered = common.copy()
    altered[30] = "other"
    docs.append((60, " ".join(new(30) + altered + new(30))))
    got = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x["doc_id"] for x in got} == {*range(3, 60, 2), 60} and {x["source_doc_id"] for x in got} == {1}
    a = np.arange(200, dtype=np.uint32)
    assert passages(a, a + np.uint32(1000), [0]) == [] and passages(a, a, [0]) == [(0, 200, 0, 200, 1.0)]


def test_every_place_and_wide_gaps(spark):
    r = random.Random(8)
    new = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage, close = new(70), new(100)
    near = close.copy()
    near[47], near[52] = "one", "two"  # 81 % of the shingles are left, in stretches of under 50 words
    head, tail = passage[:30], passage[40:]
    docs = [(0, new(20) + head + new(9) + passage + new(20)), (1, new(40) + passage + new(5) + passage + new(30)), (2, new(9) + close + new(9)), (3, new(7) + near + new(7)), (4, new(50) + tail + new(50))]
    got = repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()
    spans = {(g["doc_id"], g["source_doc_id"], g["start_word"], g["end_word"]) for g in got}
    assert spans == {(1, 0, 40, 110), (1, 0, 115, 185), (3, 2, 7, 107)}


def test_passages_of_altered_texts():
    """Of texts with words changed, put in and left out, what still has 50 words at a similarity of 0.8 is covered."""
    r, found, whole = np.random.default_rng(6), 0, 0
    for _ in range(120):
        a = r.integers(0, 2**32, 400).astype(np.uint32)
        b = a.copy()
        for at in range(int(r.integers(0, 30)), len(b) - 30, 60):
            kind = r.integers(3)
            b = np.concatenate([b[:at], r.integers(0, 2**32, int(kind < 2)).astype(np.uint32), b[at + int(kind != 1) :]])
        x = np.concatenate([r.integers(0, 2**32, 50).astype(np.uint32), b])
        covered = np.zeros(len(x), dtype=bool)
        for x0, x1, *_ in passages(a, x):
            covered[x0:x1] = True
        found, whole = found + int(covered[50:].sum()), whole + len(b)
        assert not covered[:46].any()
    assert found >= 0.97 * whole


def test_candidates_of_altered_passages(spark):
    """Of pairs that share a passage with a word in 50 changed, at least 95 in 100 are found."""
    r, docs, want = random.Random(21), [], set()
    new = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    for i in range(300):
        length = r.choice([50, 60, 75, 100, 150])
        passage = new(length)
        altered = passage.copy()
        for at in r.sample(range(length), length // 50):
            altered[at] = new(1)[0]
        pair = [new(r.randrange(20, 200)) + p + new(r.randrange(20, 200)) for p in (passage, altered)]
        docs += [(2 * i + k, " ".join(w)) for k, w in enumerate(pair)]
        number = {w: n for n, w in enumerate({*pair[0], *pair[1]})}
        a, b = (np.array([number[w] for w in p], dtype=np.uint32) for p in pair)
        if passages(a, b):
            want.add((2 * i, 2 * i + 1))
    got = {(x["source_doc_id"], x["doc_id"]) for x in repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got <= want and len(want) > 250 and len(got) >= 0.95 * len(want)


def test_no_altered_pair_is_left_out(spark):
    """Every pair that verification confirms is found: with words changed, and where the first documents of a line's key have the line alone."""
    r, docs, want = random.Random(22), [], set()
    new = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    line = new(20)

    def pair(passage, spots):
        altered, at = passage.copy(), len(docs)
        for x in spots:
            altered[x] = new(1)[0]
        both = [new(r.randrange(20, 60)) + p + new(r.randrange(20, 60)) for p in (passage, altered)]
        docs.extend(both)
        number = {w: n for n, w in enumerate({*both[0], *both[1]})}
        if passages(*(np.array([number[w] for w in p], dtype=np.uint32) for p in both)):
            want.add((at, at + 1))

    docs.extend(new(40) + line + new(40) for _ in range(40))  # a large crowd
    for _ in range(30):
        pair(new(16) + line + new(16), [r.randrange(16)])
    for _ in range(30):  # small ones
        some = new(20)
        docs.append(new(40) + some + new(40))
        pair(new(16) + some + new(16), [r.randrange(36, 52)])
    for _ in range(300):
        n = r.choice([50, 60, 75, 100, 150])
        pair(new(n), r.sample(range(n), n // 50))
    got = {(x["source_doc_id"], x["doc_id"]) for x in repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()}
    assert got == want and len(want) > 300


# 8 rollups


def test_rollup(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "s", "en"), (2, "d e", "s", None), (3, None, None, "en")], "doc_id long, text string, source string, lang string")
    count = lambda d: count_tokens(d, "words")
    r = Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().collect() == [] and r.batches() == []
    assert r.commit("one", signed(count(docs), 1)) is True
    assert r.commit("one", signed(count(docs), 1)) is False
    assert {tuple(x) for x in r.totals().collect()} == {("s", "en", "words", 1, 3), ("s", None, "words", 1, 2), (None, "en", "words", 1, 0)}
    changed = docs.filter("doc_id = 1")
    assert r.commit("two", revised(count(changed), count(changed.withColumn("text", F.lit("a b c d e"))))) is True
    r.compact()
    assert r.commit("two", signed(count(docs), 1)) is False and r.batches() == ["one", "two"]
    assert r.commit("three", signed(count(docs.filter("doc_id = 2")), -1))
    assert {tuple(x) for x in r.totals().collect()} == {("s", "en", "words", 1, 5), (None, "en", "words", 1, 0)}
    r.compact()
    assert r.totals().count() == 2 and r.commit("empty", signed(count(docs.limit(0)), 1)) and r.totals().count() == 2
    with pytest.raises(ValueError):
        r.commit("a/b", signed(count(docs), 1))


def test_rollup_query_is_a_recount(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    meta = {r["doc_id"]: (r["source"], r["lang"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r["toxic"] == 1}
    want = Counter()
    for i, text in documents.items():
        if i not in toxic:
            once = "\n".join(dict.fromkeys((text or "").split("\n")))
            for version, n in (("words", len(WORD.findall(once))), ("word_bpe_49k", len(t.encode(once, add_special_tokens=False).ids))):
                want[*meta[i], version, "docs"] += 1
                want[*meta[i], version, "tokens"] += n
    got = {(r["source"], r["lang"], r["version"], k): r[k] for r in queries.op8_token_rollup(spark, SMALL).collect() for k in ("docs", "tokens")}
    assert got == dict(want)


# 9 WARC


class Kept(io.BytesIO):
    def close(self):
        pass


@given(st.lists(st.binary(max_size=4000), min_size=1, max_size=30))
@settings(max_examples=30, deadline=None)
def test_bundles_are_seekable(payloads):
    out = Kept()
    w = BundleWriter(out)
    raws = [record(i, f"http://x/{i}\n", p, "A" * 32, None if i % 3 else 0) for i, p in enumerate(payloads)]
    at = [w.add(x) for x in raws]
    w.close()
    reader = BundleReader(out)
    for i in random.Random(1).sample(range(len(raws)), len(raws)):
        assert reader.record(*at[i]) == raws[i]
        headers, payload, http = parse(raws[i])
        assert payload == (payloads[i] if i % 3 else b"") and http["Content-Length"] == str(len(payloads[i])) and headers["X-Page-ID"] == str(i)


def test_warc_query(spark):
    import base64

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas()
    got = queries.op9_warc(spark, "/root/testdata/sf0.01").toPandas().set_index("page_id")
    first = {}
    for r in pages.sort_values("page_id").itertuples():
        raw = (r.html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        g = got.loc[r.page_id]
        assert (g["payload_bytes"], g["payload_digest"]) == (len(raw), digest)
        assert g["record_type"] == ("revisit" if digest in first else "response")
        assert digest not in first or g["refers_to"] == first[digest]
        first.setdefault(digest, r.page_id)


# 10 near-duplicates


def brute(sets, percent):
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    names = sorted(sets)
    for x, i in enumerate(names):
        for j in names[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= percent * (len(a) + len(b) - n):
                    p, q = find(i), find(j)
                    parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in names}


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_components_agree_with_brute_force(spark, documents, shingle, percent):
    sets = {i: shingle_set(t, shingle) for i, t in documents.items()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in near_duplicates(docs, shingle=shingle, percent=percent, with_rows=False).collect()}
    want = brute(sets, percent)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_groups_of_altered_copies(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    docs = [(0, " ".join(base))]
    for i in range(1, 120):
        copy = base.copy()
        for _ in range(r.randint(1, 9)):
            copy[r.randrange(300)] = f"n{r.randrange(10**9)}"
        docs.append((i, " ".join(copy)))
    docs += [(200 + i, " ".join(base[: 300 - 14 * i])) for i in range(12)]  # a chain: each like the next, the ends not
    docs += [(300 + i, " ".join(f"u{i}x{j}" for j in range(80))) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(frame, shingle=3, percent=85, with_rows=False).collect()}
    assert got == brute({i: shingle_set(t, 3) for i, t in docs}, 85)


def test_links_inside_large_buckets(spark):
    """Pairs of twins among pages of one template whose words are common ones: no pivot is like them, and their buckets have far more than SMALL."""
    r = random.Random(12)
    docs = []
    for i in range(300):
        page = [f"w{k}" for k in range(600)]
        for k in range(5, 600, 10):
            page[k] += r.choice("ab")
        twin = page.copy()
        for k in r.sample(range(0, 600, 5), 14):
            twin[k] = f"t{i}x{k}"
        docs += [(2 * i, " ".join(page)), (2 * i + 1, " ".join(twin))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(frame, shingle=3, percent=85, with_rows=False).collect()}
    want = brute({i: shingle_set(t, 3) for i, t in docs}, 85)
    assert len(set(want.values())) > 120 and got == want


def test_minima_estimate_similarity():
    r = np.random.default_rng(3)
    common, a, b = (np.unique(r.integers(0, 2**63, n).astype(U64)) for n in (800, 100, 100))
    m = minima([np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))], 1024)
    assert (m[0] == m[1]).mean() == pytest.approx(0.8, abs=0.05)
    for t in (0.8, 0.85, 0.95):
        assert (1 - t ** band_rows(t)) ** (128 // band_rows(t)) <= 1e-6


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (300, 299)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 50)} | {300: 299}


def test_passages_that_an_earlier_document_stands_for(spark):
    """As by comparing all with all, with joins on ids only: rows don't grow with the square of a document's passages."""
    from nearfield.llm.substring import _represented

    r = random.Random(4)
    rows = {(b, x, x + n, a, y, y + n) for b in range(12) for a in range(b) for _ in range(6) for x, y, n in [(r.randrange(4) * 10, r.randrange(4) * 10, 50 + r.randrange(4) * 10)]}
    names = "doc_id long, start_word int, end_word int, source_doc_id long, source_start int, source_end int"
    got = _represented(spark.createDataFrame(sorted(rows), names))
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("<" in line and "exists(" not in line for line in joins)

    def stood(b, x0, x1, a, y0, y1):
        return any(h[0] == b and h[1] <= x0 and h[2] >= x1 and h[3] < a and any(t[0] == a and t[3] == h[3] and t[1] <= y0 and t[2] >= y1 for t in rows) for h in rows)

    want = {p for p in rows if not stood(*p)}
    assert {tuple(g) for g in got.collect()} == want and 0 < len(want) < len(rows)
