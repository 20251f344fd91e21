import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import distances as D
from nearfield.operators import ann, knn, search
from nearfield.plans import queries

SCHEMA = "image_id long, vector array<float>"


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(0)
    m = r.normal(size=(120, 16)).astype(np.float32)
    data = [(1000 + i, v.tolist()) for i, v in enumerate(m)]
    return spark.createDataFrame(data, SCHEMA).cache(), m.astype(float)


def exact(m, i, k, other=False):
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - n @ n[i]
    order = [j for j in np.lexsort((np.arange(len(m)), d)) if not (other and j == i)]
    return [1000 + j for j in order[:k]]


def test_search_finds_itself(rows):
    table, m = rows
    got = search.search(table, m[3], 5).collect()
    assert [r["image_id"] for r in got] == exact(m, 3, 5)
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]
    assert got[0]["distance"] == pytest.approx(0, abs=1e-6)


def test_search_errors(rows):
    table, m = rows
    for k in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            search.search(table, m[0], k)
    with pytest.raises(ValueError):
        search.search(table, [0.0] * 16, 3)
    with pytest.raises(Exception, match="16 values"):
        search.all_distances(table, [1.0] * 5).collect()
    with pytest.raises(ValueError):
        search.search(table, m[0], 500)
    assert search.search(table, m[0], 500, on_short="clamp").count() == 120
    with pytest.warns(UserWarning):
        assert search.clamp_k(9, 3) == 3


def test_anomalies_are_left_out(spark):
    t = spark.createDataFrame([(i, [float(i)]) for i in range(6)], SCHEMA)
    odd = search.custom(lambda q, c: F.when(F.get(c, 0) == 0, float("nan")).when(F.get(c, 0) == 1, float("inf")).otherwise(D.euclidean(q, c)))
    got = search.search(t, [2.0], 3, odd).collect()
    assert [r["image_id"] for r in got] == [2, 3, 4]
    assert [r["distance"] for r in search.all_distances(t, [2.0], odd).orderBy("image_id").collect()][:2] == [math.inf, math.inf]
    with pytest.raises(ValueError):
        search.search(t, [2.0], 3, search.custom(lambda q, c: 5))


def test_ties_go_by_id(spark):
    t = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 9, 1)], SCHEMA)
    assert [r["image_id"] for r in search.search(t, [1.0, 0.0], 2).collect()] == [1, 3]


def test_zero_vectors_and_stats(spark):
    t = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [float("nan"), 1.0])], SCHEMA)
    assert search.vector_stats(t).first().asDict() == {"n": 3, "n_zero": 1, "n_invalid": 1, "min_dim": 2, "max_dim": 2}
    assert {r["image_id"] for r in search.search(t, [1.0, 0.0], 3, on_short="clamp").collect()} == {2}


def test_duplicates(spark):
    t = spark.createDataFrame([(1, [1.0]), (1, [2.0])], SCHEMA)
    with pytest.raises(ValueError):
        search.canonical_ids(t)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "chi2", "hamming", "manhattan", "dot", "angular"])
def test_knn_agrees_with_expressions(spark, metric):
    r = np.random.default_rng(1)
    m = r.integers(0, 3, size=(30, 6)).astype(float)
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], SCHEMA)
    got = knn.knn(t, 4, metric, block=7)
    want = search.ranked(t.alias("c").crossJoin(t.select(F.col("image_id").alias("query_id"), F.col("vector").alias("q"))).select("query_id", "image_id", D.metric(metric)(D.doubles(F.col("q")), D.doubles(F.col("vector"))).alias("distance")).filter(D.is_finite(F.col("distance"))), "distance", ["query_id"], 4)
    key = lambda d: sorted((x["query_id"], x["rank"], x["image_id"], round(x["distance"], 6) + 0.0) for x in d.collect())
    near = [(a[0], a[1], a[3]) for a in key(got)]
    assert near == [(a[0], a[1], a[3]) for a in key(want)]


def test_knn_self(rows):
    table, m = rows
    found = knn.knn(table, 3, block=50)
    assert knn.self_match(found, 1e-6).isEmpty()
    others = knn.knn(table, 3, include_self=False, block=50).filter("query_id = image_id")
    assert others.isEmpty()
    assert knn.knn(table.limit(2), 8).count() == 4
    with pytest.raises(ValueError):
        knn.knn(table, 0)
    with pytest.raises(ValueError):
        knn.knn(table, 2, "none")


def test_signkeys_recall_and_rerank(rows):
    table, m = rows
    index = ann.SignKeys(table, tables=40, depth=4).build()
    queries = table.filter("image_id % 20 = 0").withColumnRenamed("image_id", "query_id")
    got = {(r["query_id"], r["image_id"]) for r in index.search_many(queries, 5).collect()}
    want = {(1000 + i, j) for i in range(0, 120, 20) for j in exact(m, i, 5)}
    assert len(got & want) / len(want) >= 0.9
    assert 0 < index.admitted(m[0]) <= 1
    assert index.search(m[0], 1).first()["image_id"] == 1000


def recall(spark, name, sf="/root/testdata/sf0.001"):
    """Of the registered query, over all its queries, against brute force."""
    e = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()}
    e = {i: v / np.linalg.norm(v) for i, v in e.items() if np.linalg.norm(v) > 0}
    ids = np.array(sorted(e))
    m = np.array([e[i] for i in ids])
    want = {(i, j) for i in ids[ids % 20 == 0].tolist() for j in ids[np.lexsort((ids, -(m @ e[i])))[: queries.K]].tolist()}
    got = {(r["query_id"], r["image_id"]) for r in queries.queries()[name](spark, sf).collect()}
    return len(got & want) / len(want)


@pytest.mark.parametrize("name", ["signkey_knn", "signkey_topk", "cell_topk", "lsh_topk"])
def test_registered_index_recall(spark, name):
    assert recall(spark, name) >= 0.9


@pytest.mark.parametrize("make", [lambda t: ann.SignKeys(t, tables=8, depth=3), lambda t: ann.Cells(t, cells=4, probes=2), lambda t: ann.BucketedLSH(t, bucket=0.5)])
def test_index_lifecycle(rows, tmp_path, make):
    table, m = rows
    index = make(table)
    assert index.refresh(str(tmp_path / "i"), [0, 1]) is True
    again = make(table)
    assert again.refresh(str(tmp_path / "i"), [1, 0]) is False
    assert again.search(m[2], 1).first()["image_id"] == 1002
    assert make(table).refresh(str(tmp_path / "i"), [0, 1, 2]) is True
    assert again.manifest()["num_vectors"] == 120
    with pytest.raises(ValueError):
        again.search(m[2], 500, on_short="error")


def test_index_leaves_zero_vectors_out(spark):
    t = spark.createDataFrame([(1, [1.0] * 4), (2, [0.0] * 4)], SCHEMA)
    index = ann.SignKeys(t).build()
    assert index.num_vectors == 1
    with pytest.raises(ValueError):
        ann.SignKeys(t.filter("image_id = 2")).build()
    with pytest.raises(ValueError):
        ann.SignKeys(t, "chi2")


@pytest.mark.parametrize("make", [lambda t: ann.SignKeys(t, tables=8, depth=3), lambda t: ann.Cells(t, cells=4, probes=2), lambda t: ann.BucketedLSH(t, bucket=0.5)])
def test_candidate_pairs_are_not_rows(spark, make, monkeypatch):
    """What is ranked is k rows of each query and block, not every row that a query meets."""
    m = np.random.default_rng(2).normal(size=(2000, 8)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], SCHEMA).cache()
    seen = []
    monkeypatch.setattr(ann, "ranked", lambda rows, *how: (seen.append(rows.count()), search.ranked(rows, *how))[1])
    assert make(table).build().search_many(table.filter("image_id % 20 = 0").withColumnRenamed("image_id", "query_id"), 3).count() == 300
    assert 300 <= seen[0] <= 300 * 8


@pytest.mark.parametrize("make", [ann.SignKeys, lambda t: ann.BucketedLSH(t, bucket=0.25)])
def test_tasks_keep_k_rows_over_all_their_blocks(spark, monkeypatch, make):
    """However many blocks a task meets, k rows a query leave it; keys are never rows, and the k nearest candidates are found."""
    m = np.random.default_rng(8).normal(size=(600, 6))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], SCHEMA).cache()
    queries = table.filter("image_id % 20 = 0").withColumnRenamed("image_id", "query_id")
    monkeypatch.setattr(ann, "VALUES", 6 * 10, raising=False)
    monkeypatch.setattr(ann, "ROW_PARTS", 2)
    monkeypatch.setattr(ann, "DEPTH", 100, raising=False)
    seen = []
    monkeypatch.setattr(ann, "ranked", lambda rows, *how: (seen.append((rows.count(), rows._jdf.queryExecution().toString())), search.ranked(rows, *how))[1])
    index = make(table).build()
    got = {}
    for r in index.search_many(queries, 3).collect():
        got.setdefault(r["query_id"], []).append(r["image_id"])
    assert seen[0][0] <= 30 * 3 * 2 and "Generate" not in seen[0][1]
    keys = {}
    for r in index.table.collect():
        keys.setdefault(r["image_id"], set()).add((r["table"], r["key"]))
    near = lambda a, b: a == b or isinstance(index, ann.SignKeys) and a[0] == b[0] and bin(a[1] ^ b[1]).count("1") == 1
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 600, 20):
        some = [i for i in range(600) if any(near(a, b) for a in keys[q] for b in keys[i])]
        assert got[q] == sorted(some, key=lambda i: -(unit[i] @ unit[q]))[:3]


@pytest.mark.parametrize("make", [ann.SignKeys, lambda t: ann.BucketedLSH(t, bucket=0.25)])
def test_tasks_know_how_near_rows_have_to_be(spark, monkeypatch, make):
    """Some rows are met first: what is farther than the k nearest of them leaves no task, and the k nearest candidates are found."""
    m = np.random.default_rng(9).normal(size=(900, 6))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], SCHEMA).cache()
    queries = table.filter("image_id % 20 = 0").withColumnRenamed("image_id", "query_id")
    for name, value in (("VALUES", 6 * 10), ("ROW_PARTS", 9), ("TASKS", 90), ("MANY", 100), ("FIRST", 300), ("STEP", 7), ("TILE", 4), ("WIDE", 3)):
        monkeypatch.setattr(ann, name, value, raising=False)
    seen = []
    monkeypatch.setattr(ann, "ranked", lambda rows, *how: (seen.append(rows.count()), search.ranked(rows, *how))[1])
    index = make(table).build()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = {(r["query_id"], r["rank"]): r["image_id"] for r in index.search_many(queries, 3).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert 45 * 3 <= seen[0] <= 45 * 3 * 5  # nine parts, each of which would have k rows a query
    has, asks = index._coders()
    codes, asked = has(m), asks(m)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 900, 20):
        some = [i for i in range(900) if np.isin(codes[i], asked[q]).any()]
        assert [got[q, rank] for rank in (1, 2, 3)] == sorted(some, key=lambda i: -(unit[i] @ unit[q]))[:3]


def test_odd_vectors_by_tiles(monkeypatch):
    """Angles of vectors that are not finite, huge, tiny or zero: what a whole matrix of distances says."""
    r = np.random.default_rng(4)
    q, c = r.normal(size=(30, 5)), r.normal(size=(200, 5))
    for m in (q, c):
        m[0], m[1, 2], m[2, 3], m[3], m[4], m[5] = 0.0, np.nan, np.inf, m[3] * 1e30, m[4] * 1e-30, m[6]
    for name, value in (("STEP", 11), ("TILE", 8), ("WIDE", 4)):
        monkeypatch.setattr(ann, name, value, raising=False)
    one = np.zeros(200, dtype=np.int64)
    x, y, d = ann._meet(np.arange(30), q.ravel(), one[:30], one[:30] + 1, np.arange(200), c.ravel(), one, one + 1, 4, "angular")
    with np.errstate(all="ignore"):
        sizes = np.sqrt(np.cumsum(q * q, axis=1)[:, -1])[:, None] * np.sqrt(np.cumsum(c * c, axis=1)[:, -1])
        all_ = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.cumsum(q[:, None] * c, axis=2)[..., -1] / sizes))
    all_[sizes == 0] = np.inf
    want = {(i, int(j)): all_[i, j] for i in range(30) for j in np.lexsort((np.arange(200), all_[i]))[:4]}
    got = dict(zip(zip(x.tolist(), y.tolist(), strict=True), d.tolist(), strict=True))
    assert got.keys() == want.keys() and all(got[p] == want[p] or np.isnan(got[p]) and np.isnan(want[p]) for p in want)


def test_lsh_codes_are_those_of_spark(spark, rows):
    """Tasks make the hashes that Spark's model gives."""
    table, m = rows
    index = ann.BucketedLSH(table, bucket=0.25).build()
    has, _ = index._coders()
    want = {(r["image_id"], (r["table"] << 48) + r["key"]) for r in index.table.collect()}
    assert {(1000 + i, code) for i, codes in enumerate(has(np.array(m, dtype=float)).tolist()) for code in codes} == want


@pytest.mark.parametrize("metric", D.INDEX_METRICS)
def test_blocks_agree_with_expressions(spark, metric):
    """Rows that share a code with a query, the k nearest of them, ties by id."""
    r = np.random.default_rng(3)
    q, c = r.integers(-1, 2, size=(9, 5)).astype(float), r.integers(-1, 2, size=(60, 5)).astype(float)
    q[0], c[c.any(1) == 0] = 0.0, 1.0
    asked, has = r.integers(0, 6, size=(9, 2)), r.integers(0, 6, size=(60, 1))
    has[has == asked[1, 0]] = 9  # this query meets what its other code has only
    ids = r.permutation(60)
    x, y, d = ann._meet(np.arange(9), q.ravel(), asked.ravel(), np.full(9, 2), ids, c.ravel(), has.ravel(), np.ones(60, dtype=int), 4, metric)
    pairs = [(i, int(ids[j]), q[i].tolist(), c[j].tolist()) for i in range(9) for j in range(60) if has[j, 0] in asked[i]]
    rows = spark.createDataFrame(pairs, "query_id long, image_id long, q array<double>, c array<double>")
    want = search.ranked(rows.select("query_id", "image_id", D.metric(metric)(F.col("q"), F.col("c")).alias("distance")), "distance", ["query_id"], 4)
    assert sorted(zip(x.tolist(), y.tolist(), d.tolist(), strict=True)) == sorted((w["query_id"], w["image_id"], w["distance"]) for w in want.collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="tables of the check tool")
def test_cell_recall_on_a_larger_table(spark):
    got = queries.queries()["cell_topk"](spark, "/root/testdata/check_s").select("query_id", "image_id").collect()
    e = spark.read.parquet("/root/testdata/check_s/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    ids, m = e["vec_id"].to_numpy(), np.stack(e["embedding"]).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {(int(ids[i]), int(j)) for i in np.flatnonzero(ids % 20 == 0) for j in ids[np.lexsort((ids, -(m @ m[i])))[: queries.K]]}
    assert len(want & {(r[0], r[1]) for r in got}) >= 0.9 * len(want)


def test_letters_are_counted_in_one_pass(spark, tmp_path):
    """Any text, and no expression for each letter."""
    import duckdb

    from nearfield.plans import sql

    texts = ["Abc, cab! \u00e9 \u212a", None, "", "zzz ZZ\n9", "\u00c9\u00df \u4e2d", "abccab k", "x" * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.document_letters_topk(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(sql.oracle_sql()["document_letters_topk"]).fetchall())
    assert "translate" not in got._jdf.queryExecution().optimizedPlan().toString()
