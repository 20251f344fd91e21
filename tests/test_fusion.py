import pytest

from nearfield.operators import fusion, query, search
from nearfield.schemas import DISTANCES


def distances(spark, **features):
    rows = [(0, f, i, float(d)) for f, ds in features.items() for i, d in enumerate(ds)]
    return spark.createDataFrame(rows, DISTANCES)


def scores(df):
    return [r["score"] for r in df.orderBy("image_id").collect()]


def norms(df):
    return [r["norm"] for r in df.orderBy("image_id").collect()]


def test_normalised(spark):
    assert norms(fusion.normalised(distances(spark, a=[1, 2, 3]))) == [0, 0.5, 1]
    assert norms(fusion.normalised(distances(spark, a=[1, 1, 1]))) == [0, 0, 0]


def test_golden_weights(spark):
    d = distances(spark, hsv=[1, 5, 7], embedding=[4, 9, 3])
    assert scores(fusion.fuse(d, {"hsv": 0.3, "embedding": 0.7})) == pytest.approx([0.1166667, 0.9, 0.3])
    d = distances(spark, hsv=[1, 2, 7], embedding=[5, 9, 6], phash=[2, 2, 2])
    assert scores(fusion.fuse(d, {"hsv": 0.2, "embedding": 0.6, "phash": 0.2})) == pytest.approx([0, 0.7916667, 0.4375])


def test_mean_and_constant(spark):
    d = distances(spark, hsv=[1, 0.5, 0], embedding=[0, 0.5, 0.2])
    assert scores(fusion.fuse(d)) == pytest.approx([0.5, 0.75, 0.2])
    assert scores(fusion.fuse(distances(spark, a=[1, 1, 1], b=[2, 2, 2]))) == [0, 0, 0]
    d = distances(spark, a=[1, 1, 1], b=[0, 1, 2])
    assert scores(fusion.fuse(d)) == [0, 0.5, 1]


def test_bad_weights(spark):
    d = distances(spark, hsv=[1, 2], phash=[3, 4])
    for w in ({"hsv": 1.0}, {"hsv": 0.5, "phash": 0.6}, {"hsv": -0.5, "phash": 1.5}, {"hsv": "x", "phash": 1}, {"hsv": 0.5, "phash": 0.5, "z": 0.0}):
        with pytest.raises(ValueError):
            fusion.fuse(d, w)
    lost = distances(spark, hsv=[1, 2], phash=[3, 3])
    with pytest.raises(Exception, match="weights"):
        fusion.fuse(lost, {"hsv": 0.0, "phash": 1.0}).collect()


def test_infinite_distances(spark):
    d = distances(spark, e=[0, 1, float("inf")], h=[0, 1, 2])
    assert scores(fusion.fuse(d)) == [0, 0.75, 1]
    assert scores(fusion.fuse(d, strict=True)) == [0, 0.5, 1]
    assert norms(fusion.normalised(distances(spark, e=[float("nan"), 2, 4]))) == [1, 0, 1]


def test_multi_query_mean(spark):
    d = spark.createDataFrame([(0, 1, 0.0), (0, 2, 1.0), (1, 1, 0.5), (1, 2, 0.0)], "query_id long, image_id long, score double")
    assert scores(fusion.fuse_queries(d)) == [0.25, 0.5]
    with pytest.raises(Exception, match="different images"):
        fusion.fuse_queries(d.filter("not (query_id = 1 and image_id = 2)")).collect()


def test_alignment(spark):
    canonical = spark.createDataFrame([(0, 3), (1, 2), (2, 1)], "position long, image_id long")
    found = spark.createDataFrame([(1, 10.0), (2, 5.0), (3, 2.0)], "image_id long, distance double")
    assert [r["distance"] for r in fusion.aligned(canonical, found).orderBy("position").collect()] == [2, 5, 10]
    with pytest.raises(ValueError):
        fusion.aligned(canonical, found.union(found.limit(1)))
    with pytest.raises(ValueError):
        fusion.aligned(canonical, found.filter("image_id < 3"))
    with pytest.raises(ValueError):
        fusion.aligned(canonical.filter("position < 2"), found)


@pytest.fixture(scope="module")
def store(spark):
    t = lambda rows: spark.createDataFrame(rows, "image_id long, vector array<double>")
    return {
        "embedding": t([(i, [1.0, i / 10]) for i in range(8)]),
        "hsv": t([(i, [1 - i / 10, i / 10]) for i in range(8)]),
        "phash": t([(i, [float(i % 2), float(i // 2 % 2), float(i // 4)]) for i in range(8)]),
    }


def vectors(store, i):
    from nearfield.operators.evaluate import query_vectors

    return query_vectors(store, [i])[i]


def ids(df):
    return [r["image_id"] for r in df.orderBy("rank").collect()]


def test_single_query(store):
    best = query.single_query(store, vectors(store, 3), 4)
    assert ids(best)[0] == 3 and best.first()["score"] == 0
    assert ids(query.single_query(store, vectors(store, 3), 4)) == ids(best)
    assert len(ids(query.single_query(store, vectors(store, 3), 50))) == 8
    all_ = query.single_query(store, vectors(store, 3), 8, backend="candidates", k_candidates=100)
    assert ids(all_) == ids(query.single_query(store, vectors(store, 3), 8))
    assert set(ids(query.single_query(store, vectors(store, 3), 3, backend="candidates", k_candidates=3))) == {2, 3, 4}
    with pytest.raises(ValueError):
        query.single_query(store, vectors(store, 3), 3, backend="none")


def test_feature_choice(store):
    v = vectors(store, 1)
    assert query.select_features(list(store), ["hsv", "phash"], v) == ["hsv", "phash"]
    with pytest.warns(UserWarning):
        assert query.select_features(list(store), ["hsv", "nothing"]) == ["hsv"]
    with pytest.raises(ValueError):
        query.select_features(["hsv"], [])
    with pytest.raises(ValueError):
        query.require_features(["hsv"], ["hsv", "phash"])
    with pytest.warns(UserWarning, match="left out"):
        d = query.feature_distances(store, v | {"embedding": [0.0, 0.0]})
    assert {r[0] for r in d.select("feature").distinct().collect()} == {"hsv", "phash"}


def test_multi_query(store):
    a, b = vectors(store, 2), vectors(store, 5)
    assert sorted(ids(query.multi_query(store, [a, b], 8))) == list(range(8))
    assert ids(query.multi_query(store, [a, b], 8)) == ids(query.multi_query(store, [b, a], 8))
    first = query.multi_query(store, [a, b], 3, backend="candidates", k_candidates=3)
    assert set(ids(first)) == {1, 2, 3}
    with pytest.raises(ValueError):
        query.multi_query(store, [a], 3)
    with pytest.raises(ValueError):
        query.multi_query(store, [a, {"hsv": b["hsv"]}], 3)


def test_session(store):
    s = query.Session(store, features=["embedding"])
    assert ids(s.ask(vectors(store, 4), 1)) == [4]
    assert len(ids(s.ask([vectors(store, 4), vectors(store, 6)], 2))) == 2
    rows, times = query.timed_query(store, vectors(store, 0), 2)
    assert len(rows) == 2 and times["total_ms"] > 0


def test_checked_alignment(store):
    fusion.assert_aligned(query.feature_distances(store, vectors(store, 0)))
    broken = dict(store) | {"hsv": store["hsv"].filter("image_id < 7")}
    with pytest.raises(ValueError):
        fusion.assert_aligned(query.feature_distances(broken, vectors(store, 0)))
    assert search.check_queries(store["hsv"].withColumnRenamed("image_id", "query_id")).count() == 8
