"""Cases that every operator must stand: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from nearfield.llm import quality
from nearfield.llm.decontaminate import decontaminated, leaks
from nearfield.llm.fingerprint import fingerprints
from nearfield.llm.minhash import near_duplicates
from nearfield.llm.mixing import mix_copies, source_targets
from nearfield.llm.queries import URL_RULES, tokenizer_path
from nearfield.llm.substring import repeated_passages
from nearfield.llm.token_rollup import count_tokens, signed
from nearfield.llm.tokenfile import write_and_read
from nearfield.llm.url_filter import filter_urls
from nearfield.llm.warc import bundle_and_read

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, copies string, _k long, component_id string, _leaky int"


def text(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


LONG = text(99, 60_000)
ROWS = [
    (1, text(1), "en", "a"),
    (2, text(1), "en", "a"),
    (2, text(1), "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n ", "", ""),
    (None, text(1), "en", "a"),
    (None, None, None, None),
    (6, LONG, "de", "a"),
    (7, "one", "de", None),
    (8, text(8) + " ünï ☃ 😀 " + "x" * 3000, "fr", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 7, "x", 3, "y", 0) for r in ROWS], SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "t"), (2, 1, 0, "t"), (4, 0, 0, "t"), (7, 0, 0, "t"), (None, 1, 0, "t"), (99, 0, 1, "t"), (1, None, 0, "t")], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, text(1, 30)), (2, None), (3, ""), (4, "one"), (None, text(8, 20))], "item_id long, text string")


def both(docs, run):
    """The result over the rows, and over none of them."""
    found = run(docs).collect()
    assert run(docs.filter("doc_id = -1")).collect() == []
    return found


def test_mixing(docs):
    out = both(docs, lambda d: mix_copies(d, targets_of=lambda s: [source_targets(s[0])]))
    assert len(out) == len(ROWS)
    names = [c for c in mix_copies(docs, targets_of=lambda s: [source_targets(s[0])]).columns]
    assert names[: len(docs.columns)] == docs.columns and "_copies" in names and "_size" in names
    for r in out:
        assert 0 <= r["_copies"] <= 2 and r["_size"] == len((r["text"] or "").split())
    assert mix_copies(docs, targets_of=lambda s: [source_targets(s[0])]).collect() == out


def test_leaks(docs, benchmark):
    out = both(docs, lambda d: leaks(d, benchmark))
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(1, 1), (2, 1), (None, 1), (7, 4), (8, None)}
    assert leaks(docs, benchmark.limit(0)).collect() == []
    kept = decontaminated(docs, benchmark)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.orderBy("doc_id").collect()] == [None, 3, 4, 5, 6]


def test_token_files(docs):
    out = both(docs, lambda d: write_and_read(d, tokenizer_path()))
    assert len(out) == len(ROWS) and sum(r["doc_id"] is None for r in out) == 2
    assert {r["n_tokens"] for r in out if r["doc_id"] in (3, 4, 5)} == {1}


def test_fingerprints(docs):
    out = both(docs, fingerprints)
    assert len(out) == len(ROWS)
    prints = {r["doc_id"]: r["fingerprint"] for r in out if r["doc_id"]}
    assert prints[1] == prints[2] and prints[3] == prints[4] == prints[5] != prints[7]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)


def test_quality(docs, labels):
    model = quality.fit(docs, labels)
    out = both(docs, lambda d: quality.score(d, model))
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    good = quality.good(docs, model)
    assert good.schema == docs.schema
    assert quality.fit(docs, labels.limit(0)).constant == 0.5
    assert quality.fit(docs.limit(0), labels).constant == 0.5
    assert both(docs, lambda d: quality.score(d, quality.fit(docs, labels.limit(0))))[0]["score"] == 0.5


def test_passages(docs):
    out = both(docs, repeated_passages)
    assert {(r["doc_id"], r["source_doc_id"]) for r in out} == {(2, 1)}
    assert {(r["start_word"], r["end_word"], r["similarity"]) for r in out} == {(0, 60, 1.0)}


def test_token_counts(docs):
    for path in (None, tokenizer_path()):
        out = both(docs, lambda d, p=path: count_tokens(d, "v", p))
        assert len(out) == len(ROWS) and {r["tokens"] for r in out if r["doc_id"] in (3, 4, 5)} == {0}
    assert sum(r["docs"] for r in signed(count_tokens(docs, "v"), -1).collect()) == -len(ROWS)


def test_near_duplicates(docs):
    out = both(docs, near_duplicates)
    assert len(out) == len(ROWS)
    names = near_duplicates(docs).columns
    assert names[: len(docs.columns)] == docs.columns and names[len(docs.columns) :] == ["n_shingles", "_component_id", "kept"]
    comp = {(r["doc_id"], r["text"]): (r["_component_id"], r["kept"]) for r in out}
    assert comp[1, text(1)] == (1, True) and comp[2, text(1)] == (1, False) and comp[None, text(1)] == (1, False)
    assert comp[3, None] == (3, True) and comp[4, ""] == (4, True)
    short = near_duplicates(docs, with_rows=False, shingle=3, percent=85).collect()
    assert len(short) == len(ROWS) and {r["n_shingles"] for r in short if r["doc_id"] in (3, 4, 5)} == {0}


def test_urls(spark):
    rows = [(1, "http://A.Example.COM/en/7?x"), (1, "http://A.Example.COM/en/7?x"), (2, None), (3, ""), (4, "no scheme/com/en/"), (5, "x://example.com"), (None, "http://com/en/"), (6, "http://h" + "/a" * 40_000), (7, "http://u:p@example.com:80/en/"), (8, "a://b://com/en/")]
    pages = spark.createDataFrame([(*r, "h", "r") for r in rows], "page_id long, url string, host string, rule string")
    out = {(r["page_id"], r["host"], r["path"][:9], r["rule"], r["verdict"]) for r in filter_urls(pages, URL_RULES).collect()}
    assert out == {(1, "a.example.com", "/en/7", "example.com/en/7", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "example.com", "", None, "allow"), (None, "com", "/en/", "com/en/", "block"), (6, "h", "/a/a/a/a/", None, "allow"), (7, "u:p@example.com:80", "/en/", None, "allow"), (8, "b:", "//com/en/", None, "allow")}
    assert filter_urls(pages.limit(0), URL_RULES).collect() == []
    assert filter_urls(pages, []).filter("verdict = 'allow'").count() == len(rows)


def test_warc(spark):
    rows = [(3, "u", "same"), (1, "v\r\nx", "same"), (1, "v", "same"), (None, None, "same"), (4, "w", None), (5, None, ""), (None, "z", "ü" * 300_000), (6, "y", "a\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    out = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in bundle_and_read(spark, pages).collect()), key=repr)
    assert out == sorted([(3, 4, "revisit", 1), (1, 4, "response", None), (1, 4, "response", None), (None, 4, "revisit", 1), (4, 0, "response", None), (5, 0, "revisit", 4), (None, 600_000, "response", None), (6, 15, "response", None)], key=repr)
    assert bundle_and_read(spark, pages.limit(0)).collect() == []


def test_pipeline_stages_keep_columns(spark, docs, labels, benchmark, tmp_path):
    import corpus_pipeline as p

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, table in (("documents", plain), ("labels", labels.drop("text")), ("benchmark", benchmark)):
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = plain
    for name, stage in p.STAGES:
        rows = stage(spark, rows, str(tmp_path))
        rows.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert rows.columns == plain.columns
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    empty = tmp_path / "empty"
    for name, table in (("documents", plain), ("labels", labels.drop("text")), ("benchmark", benchmark)):
        table.limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert p.run(spark, str(empty)).agg(F.count(F.lit(1))).first()[0] == 0


def test_near_dedup_keeps_null_ids_and_texts_of_one_id(spark):
    import corpus_pipeline as p

    rows = [(1, text(21), "b"), (1, text(21), "a"), (2, text(22), "a"), (2, text(23), "a"), (None, text(24), "a"), (None, text(25), "a"), (3, text(26), "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((tuple(r) for r in p.near_dedup(spark, frame, "").collect()), key=repr)
    assert got == sorted(set(rows[1:]), key=repr)
